"""Fill-in-the-middle: texts cut into prefix, middle and suffix at places that a hash of the id decides, and put together in another order.

One automaton scans a text for the events that matter: sentinels, which forbid a cut, and the ASCII characters that change
the class a unit is made of (white space for words, line ends for lines). The gaps between events count their units
arithmetically: each character of a gap is a unit, or the whole gap is one, or none. So a text has a sparse
table (place, units before it), in which a binary search finds the place of the r-th unit. Characters change no class: the
table has one row, and places are arithmetic.
"""

from __future__ import annotations

import bisect
import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, lean

SENTINELS = ("<P>", "<S>", "<M>")
#: The ASCII characters that change the class, of each kind of unit.
EVENTS = {"character": "", "word": " \t\n\x0b\x0c\r", "line": "\n"}


class Units:
    """The units of texts: characters (code points), words (each with the white space behind it; what stands before the first
    belongs to it) or lines (each with its line end)."""

    def __init__(self, unit: str = "character", sentinels: tuple[str, str, str] = SENTINELS):
        self.unit, self.scan = unit, ahocorasick.Automaton()
        for c in EVENTS[unit]:
            self.scan.add_word(c, 0)
        for s in sentinels:
            self.scan.add_word(s, len(s))
        self.scan.make_automaton()

    def table(self, text: str) -> tuple[list[int], list[int], int, bool]:
        """(places, units before each of them, all units, whether there is a sentinel)."""
        places, before, marked, start = [0], [0], False, 0
        units, n = 0, len(text)
        for end, length in self.scan.iter(text):
            if length:
                marked = True
            elif self.unit == "line" or end > start:  # a gap of words' characters, or a line, ends here
                units += 1
                if self.unit == "line":
                    places.append(end + 1)
                    before.append(units)
                elif units > 1:
                    places.append(start)
                    before.append(units - 1)
            if not length:
                start = end + 1
        if self.unit == "character":
            units = n
        elif start < n:
            units += 1
            if self.unit == "word" and units > 1:
                places.append(start)
                before.append(units - 1)
        elif n and not units:  # white space only
            units = 1
        return places, before, units, marked

    def place(self, places: list[int], before: list[int], units: int, n: int, r: int) -> int:
        """Where the first r units of a text of n characters end."""
        if r >= units:
            return n
        i = bisect.bisect_right(before, r) - 1
        return places[i] + (r - before[i])


def _transformed(seed: str, unit: str, sentinels: tuple[str, str, str], plain: int, spm: int):
    p, s, m = sentinels

    def one(units: Units, doc_id, text: str) -> tuple:
        places, before, n, marked = units.table(text)
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
        if not text or marked or h[2] % 100 >= 100 - plain:
            return n, "plain", None, None, text
        a, b = sorted(units.place(places, before, n, len(text), x % (n + 1)) for x in h[:2])
        if h[3] % 100 < spm:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    def run(batches):
        units = Units(unit, sentinels)
        for batch in batches:
            rows = [one(units, i, t or "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: str = "1", unit: str = "character", sentinels: tuple[str, str, str] = SENTINELS, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the text of each row in one of three forms.

    ``n`` is its number of units. ``plain`` is the text itself: of empty and null texts, of those with a sentinel, and of
    ``plain_percent`` of the rest. ``psm`` is prefix, suffix, middle, each behind its sentinel; ``spm`` (``spm_percent`` of what is
    cut) begins with the suffix. Lengths of prefix and middle are in code points, and null if plain. Each row is a document,
    repeated ones get the same form; a null id counts as an empty one. Each row is worked on alone: there is no shuffle.
    """
    if unit not in EVENTS or len(set(sentinels)) < 3 or not all(sentinels) or any(a in b for a in sentinels for b in sentinels if a != b) or any(s[:1] in s[1:] for s in sentinels):
        raise ValueError("the unit is unknown, or the sentinels can't be told apart")
    rows = documents_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_transformed(seed, unit, sentinels, plain_percent, spm_percent)), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of: no sentinel is in a text that was cut, so the first of each kind is its own."""
    p, s, m = sentinels
    behind = lambda mark: F.substring_index(output, mark, -1)
    first = lambda begin, end: F.substring_index(F.substring(output, len(begin) + 1, 2**31 - 1), end, 1)
    psm = F.concat(first(p, s), behind(m), F.substring_index(behind(s), m, 1))
    spm = F.concat(F.substring_index(behind(p), m, 1), behind(m), first(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of all documents: (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT % (length(t) + 1) AS x, ('0x' || h[9:16])::BIGINT % (length(t) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), parts AS (
  SELECT doc_id, t, n, form, least(x, y) AS a, greatest(x, y) - least(x, y) AS b FROM cut
), named AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b) AS m, substring(t, a + b + 1) AS s FROM parts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM named
"""
