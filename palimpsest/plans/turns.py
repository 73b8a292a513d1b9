"""Conversations: pairing of turns, limits and token estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import turns as T
from .core import query

_SAID = "SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS said FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


@query(f"SELECT conv_id, turn, CASE WHEN before = 'user' THEN said ELSE '' END AS user_query, text AS agent_response FROM ({_SAID}) WHERE role = 'assistant'")
def pair_last_user(t):
    return T.pair_last_user(t.conversations)


@query(f"SELECT conv_id, turn, said AS user_query, text AS agent_response FROM ({_SAID}) WHERE role = 'assistant' AND before = 'user'")
def pair_pending_user(t):
    return T.pair_last_user(t.conversations, leftover=False)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations)
SELECT u.conv_id, u.i, u.text AS user_query, a.text AS agent_response FROM n u JOIN n a ON u.conv_id = a.conv_id AND u.i = a.i AND u.role = 'user' AND a.role = 'assistant'""")
def pair_zip(t):
    return T.pair_zip(t.conversations)


@query("""WITH g AS (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, g, max(text) FILTER (WHERE role = 'user') AS user_query, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant') AS agent_response
FROM g WHERE g > 0 GROUP BY conv_id, g HAVING count(*) FILTER (WHERE role = 'assistant') > 0""")
def pair_concat_runs(t):
    return T.pair_runs(t.conversations)


@query("SELECT conv_id, turn, trim(text) = '' OR len(regexp_split_to_array(trim(text), '\\s+')) < 4 AS is_trivial FROM conversations")
def trivial_turns(t):
    return t.conversations.select("conv_id", "turn", T.trivial(F.col("text")).alias("is_trivial"))


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS n_user, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def turns_per_conversation(t):
    tokens = estimate_tokens(F.col("text"))
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("role") == "user").cast("long")).alias("n_user"), F.sum(tokens).alias("tokens"))


@query("""WITH d AS (SELECT conv_id, '_Exported on x from Cursor_' || chr(10) || '---' || chr(10) || string_agg(CASE role WHEN 'user' THEN '**User**' ELSE '**Cursor**' END || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY turn) AS t
FROM conversations WHERE role != 'system' GROUP BY conv_id)
SELECT conv_id AS id, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations WHERE role != 'system' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) != ''""")
def transcript_round_trip(t):
    """Turns written as an exported transcript and parsed again."""
    said = F.concat(F.when(F.col("role") == "user", "**User**").otherwise("**Cursor**"), F.lit("\n"), F.col("text"))
    c = t.conversations.where("role != 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("s"))
    text = F.concat(F.lit("_Exported on x from Cursor_\n---\n"), F.array_join(F.transform("s", lambda x: x["s"]), "\n---\n"))
    return T.transcript_turns(c.select(F.col("conv_id").alias("id"), text.alias("text"))).drop("turn")


_QA = """q AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant')"""


def _page(t, said):
    """A page of each conversation: what ``said`` makes of its turns, in order; user and assistant turns only."""
    c = t.conversations.where("role != 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.select("conv_id", F.array_join(F.transform("turns", said), "\n").alias("body"))


def _pairs(pages, html, url):
    from ..functions.chats import chat_pairs

    found = pages.select("conv_id", chat_pairs(html, F.lit(url)).alias("c")).select("conv_id", "c.provider", "c.method", F.posexplode("c.pairs").alias("i", "p"))
    return found.select("conv_id", "provider", "method", (F.col("i") + 1).cast("long").alias("i"), "p.user_query", "p.agent_response")


@query(f"""WITH {_QA} SELECT q.conv_id, 'chatgpt' AS provider, 'dom' AS method, q.i, CAST(length(q.text) AS VARCHAR) AS user_query, CAST(length(a.text) AS VARCHAR) AS agent_response FROM q JOIN a USING (conv_id, i)""")
def shared_chat_by_attributes(t):
    """Messages by their role attribute, question and answer by position."""
    said = lambda m: F.concat(F.lit("<div class='x' data-message-author-role=\""), m["role"], F.lit("\"><div><p>"), F.length(m["text"]).cast("string"), F.lit("</p></div></div>"))
    pages = _page(t, said)
    return _pairs(pages, F.concat(F.lit("<main>"), "body", F.lit("</main>")), "https://chatgpt.com/share/1")


@query(f"""WITH {_QA} SELECT q.conv_id, 'gemini' AS provider, 'dom' AS method, q.i, 'is ' || length(q.text) || ' < 10 & more' AS user_query, CAST(length(a.text) AS VARCHAR) AS agent_response FROM q JOIN a USING (conv_id, i)""")
def shared_chat_by_classes(t):
    """Messages by element and class names; entities are resolved."""
    user = lambda m: F.concat(F.lit("<div class='user-query wide'>is <b>"), F.length(m["text"]).cast("string"), F.lit("</b> &lt; 10 &amp; more</div>"))
    said = lambda m: F.when(m["role"] == "user", user(m)).otherwise(F.concat(F.lit("<message-content role='model'>"), F.length(m["text"]).cast("string"), F.lit("</message-content>")))
    out = _pairs(_page(t, said), F.col("body"), "https://gemini.google.com/share/2")
    return out.withColumn("user_query", F.regexp_replace("user_query", r"\s*\n\s*", " "))


@query(f"""WITH {_QA} SELECT q.conv_id, 'chatgpt' AS provider, 'dom' AS method, q.i, 'Q' || length(q.text) || chr(10) || 'nested' || chr(10) || 'tail' AS user_query, CAST(length(a.text) AS VARCHAR) AS agent_response FROM q JOIN a USING (conv_id, i)""")
def shared_chat_with_bars(t):
    """Pages as they are: blocks nested in messages, scripts within, void tags, and bars of buttons behind each message."""
    inner = lambda m: F.when(m["role"] == "user", F.concat(F.lit("Q"), F.length(m["text"]).cast("string"), F.lit("<div><div class='quote'>nested</div><img src='x'></div>tail<script>var a = '</div';</script>"))).otherwise(F.length(m["text"]).cast("string"))
    said = lambda m: F.concat(F.lit("<section><div data-message-author-role='"), m["role"], F.lit("'>"), inner(m), F.lit("</div><div class='toolbar'><span>Copy</span><span>Share</span></div></section>"))
    return _pairs(_page(t, said), F.concat(F.lit("<html><body><main>"), "body", F.lit("</main><footer>Made with care</footer></body></html>")), "https://chatgpt.com/share/4")


@query("""SELECT doc_id, 'head ' || repeat('a', 60) || chr(10) || 'inner ' || doc_id || chr(10) || 'behind it' AS first, 2::BIGINT AS n FROM documents""")
def page_texts(t):
    """Long paragraphs of pages, each with all that is in it: what follows an inner element isn't lost."""
    from ..functions.pages import page_paragraphs

    html = F.concat(F.lit("<p>head " + "a" * 60 + " <span>inner "), "doc_id", F.lit("</span> behind it</p><div>short</div><div><div><p>" + "b" * 70 + "</p></div></div>"))
    rows = t.documents.select("doc_id", page_paragraphs(html).alias("p"))
    return rows.select("doc_id", F.col("p")[0].alias("first"), F.size("p").cast("long").alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, lag(turn) OVER w AS t0 FROM conversations WHERE role != 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, 'claude' AS provider, 'structured' AS method, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN before = 'user' THEN 'm' || t0 ELSE '' END AS user_query, 'm' || turn AS agent_response FROM s WHERE role = 'assistant'""")
def shared_chat_by_state(t):
    """Messages of a page's preloaded state."""
    c = t.conversations.where("role != 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), F.concat(F.lit("m"), "turn").alias("text")))).alias("messages"))
    state = F.to_json(F.struct(F.struct("messages").alias("chat")))
    pages = c.select("conv_id", F.concat(F.lit("<script>window.__PRELOADED_STATE__ = "), state, F.lit(";</script>")).alias("html"))
    return _pairs(pages, F.col("html"), "https://claude.ai/share/3")
