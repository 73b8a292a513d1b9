"""Phrases that tell what a text is about, and the join of texts with them by token n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases of each class.
CODE = (
    "python", "javascript", "typescript", "java", "c++", "c#", "go", "rust", "ruby", "php", "swift", "kotlin", "scala", "perl", "lua", "haskell",
    "code", "coding", "program", "script", "implement", "develop", "build", "refactor", "optimize", "compile", "execute", "run", "deploy",
    "debug", "fix", "error", "bug", "issue", "exception", "stack trace", "segmentation fault", "syntax error", "runtime error", "logic error",
    "traceback", "crash", "failing", "broken", "function", "method", "class", "object", "variable", "loop", "array", "list", "map", "dictionary",
    "set", "tuple", "struct", "algorithm", "data structure", "recursion", "iteration", "api", "endpoint", "request", "response", "rest", "graphql",
    "sdk", "library", "framework", "package", "module", "import", "http", "json", "xml", "websocket", "git", "github", "docker", "kubernetes",
    "ci/cd", "pipeline", "aws", "azure", "gcp", "cloud", "server", "database", "unit test", "test case", "mock", "testing", "pytest", "jest",
    "how do i code", "write a function", "explain this code", "why is this failing", "convert this code", "refactor this", "what does this do",
    "how does this work",
)
PROFILE = (
    "my name is", "i am called", "call me", "who am i", "i'm", "i am a", "i work as", "my job is", "my profession", "i like", "i love", "i prefer",
    "my favorite", "what do i prefer", "i enjoy", "i hate", "i dislike", "can't stand", "i'm into", "i usually", "i often", "i always", "i never",
    "i sometimes", "every day", "daily routine", "my habit", "i live in", "i am from", "my city is", "my country is", "i grew up in", "my hometown",
    "based in", "my phone number", "my email", "my age is", "i am X years old", "my address", "my gender", "my nationality", "my wife",
    "my husband", "my partner", "my kids", "my children", "my mom", "my dad", "my parents", "my family", "my friend", "my brother", "my sister",
    "my son", "my daughter", "i believe", "i value", "important to me", "i care about", "my personality", "i'm the type of person",
    "remember this", "store this", "save this", "add to my profile", "keep this in mind", "note this down", "store this fact", "update my",
    "change my", "that is wrong", "actually i am", "my hobby", "i'm interested in", "passionate about", "i volunteer", "i support", "i'm learning",
)
EVENT = (
    "schedule", "book", "plan", "set up", "arrange", "create event", "remind me", "set a reminder", "alarm", "notify me", "ping me", "meeting",
    "call", "appointment", "interview", "session", "deadline", "standup", "demo", "reservation", "today", "tomorrow", "day after tomorrow",
    "next week", "next month", "next year", "this weekend", "upcoming", "soon", "later", "in a few days", "monday", "tuesday", "wednesday",
    "thursday", "friday", "saturday", "sunday", "in the morning", "in the evening", "at night", "afternoon", "am", "pm", "o'clock", "calendar",
    "add to calendar", "reschedule", "cancel meeting", "yesterday", "last week", "last month", "last year", "last saturday", "last sunday",
    "last monday", "last tuesday", "last wednesday", "last thursday", "last friday", "years ago", "months ago", "weeks ago", "days ago",
    "a year ago", "a month ago", "a week ago", "back in", "when i was", "used to", "in the past", "recently", "just", "the other day", "in 2020",
    "in 2021", "in 2022", "in 2023", "in 2024", "in 2025", "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december", "birthday", "anniversary", "graduation", "wedding", "funeral", "holiday", "christmas", "thanksgiving",
    "new year", "easter", "valentine", "halloween", "independence day", "born on", "born in", "turned", "18th birthday", "21st birthday",
    "when i turned", "at age", "years old when", "moved", "started", "graduated", "married", "retired", "began", "finished", "completed",
    "launched", "opened", "closed", "joined", "left", "quit", "hired", "fired", "promoted", "divorced", "engaged", "pregnant", "gave birth",
    "adopted", "surgery", "diagnosed", "recovered", "hospitalized", "traveled", "visited", "went to", "came back from", "first time", "last time",
    "this was when",
)
CLASSES = {"code": CODE, "profile": PROFILE, "event": EVENT}

#: Topics of a profile with their sub-topics; what is said of one stands behind it.
SUB_TOPICS = {
    "basic_info": ("Name", "Age(integer)", "Gender", "birth_date", "nationality", "ethnicity", "language_spoken"),
    "contact_info": ("email", "phone", "city", "country"),
    "education": ("school", "degree", "major"),
    "demographics": ("marital_status", "spouse_name", "number_of_children", "household_income", "relationship"),
    "work": ("company", "title", "working_industry", "previous_projects", "work_skills"),
    "interest": ("books", "movies", "music", "foods", "sports", "hobbies", "art", "travel", "games"),
    "life_event": ("marriage", "relocation", "retirement", "health", "achievement"),
}

#: What a token is: letters and digits, joined by single apostrophes and slashes, and plus and number signs behind them.
TOKEN = r"[\p{L}\p{N}]+(?:['/][\p{L}\p{N}]+)*[+#]*"

#: Phrases that are broadcast at most, of few tokens each, and different first tokens of theirs.
BROADCAST_PHRASES, BROADCAST_HEADS = 200_000, 10_000


def tokens(text: Column) -> Column:
    """The tokens of a text in lower case, typographic apostrophes as plain ones; of null none."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'")), F.lit(TOKEN), F.lit(0))


def vocabulary(spark: SparkSession, classes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(class, phrase) with phrases as their tokens, joined by blanks."""
    rows = [(c, p) for c, phrases in (classes or CLASSES).items() for p in phrases]
    df = spark.createDataFrame(rows, "class string, phrase string")
    return df.select("class", F.array_join(tokens(F.col("phrase")), " ").alias("phrase")).distinct()


def phrase_hits(texts: DataFrame, phrases: DataFrame, id_col: str = "id", text_col: str = "text", longest: int = 5) -> DataFrame:
    """(id, class, n_hits, n_phrases): how often phrases of each class occur in a text, and how many different ones; texts without any have no rows.

    phrases: (class, phrase) of at most ``longest`` tokens each; a table of any size, broadcast up to a counted bound. A text is tokenised once; its n-grams of each
    length, from places where a phrase may begin, are hashed and joined with the hashes of the phrases, then compared. So the work doesn't grow with the number of phrases.
    Only hits are ever shuffled. Phrases overlap: each of them counts wherever it begins.
    """
    known = phrases.select("class", "phrase").where("phrase IS NOT NULL").distinct().withColumn("hash", F.xxhash64("phrase"))
    heads = known.select(F.substring_index("phrase", " ", 1).alias("head")).distinct().limit(BROADCAST_HEADS + 1).toArrow()["head"].to_pylist()
    small = len(heads) <= BROADCAST_HEADS and known.limit(BROADCAST_PHRASES + 1).count() <= BROADCAST_PHRASES
    rows = texts.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(1), F.size("t"))
    if small:  # n-grams that no phrase begins like aren't made
        starts = F.filter(starts, lambda i: F.element_at("t", i).isin(heads))
    gram = lambda i, n: F.when(i + (n - 1) <= F.size("t"), F.array_join(F.slice("t", i, n), " "))
    grams = F.flatten(F.transform(starts, lambda i: F.array(*[gram(i, n) for n in range(1, longest + 1)])))
    rows = rows.select("id", F.explode(grams).alias("gram")).where("gram IS NOT NULL").withColumn("hash", F.xxhash64("gram"))
    hits = rows.join(F.broadcast(known) if small else known.hint("merge"), "hash").where(F.col("gram") == F.col("phrase"))
    return hits.groupBy("id", "class").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("phrase").alias("n_phrases"))


def known_sub_topic(topic: Column, sub_topic: Column) -> Column:
    """Whether a topic has that sub-topic, in any case; of null neither."""
    catalog = F.create_map(*[x for t, subs in SUB_TOPICS.items() for x in (F.lit(t), F.array(*[F.lit(s.split("(")[0].lower()) for s in subs]))])
    return F.coalesce(F.array_contains(F.try_element_at(catalog, F.lower(topic)), F.lower(sub_topic)), F.lit(False))


def topic_list(topics: dict[str, tuple[str, ...]] | None = None) -> str:
    """Topics and sub-topics as a list for a model, with an open end."""
    lines = [line for t, subs in (topics or SUB_TOPICS).items() for line in (f"- {t}", *(f"  - {s}" for s in subs))]
    return "\n".join([*lines, "..."])
