"""Pairs of question and answer out of shared chat pages, by what each provider's pages are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pages import page_messages, page_paragraphs
from .text import provider

_PAIRS = "array<struct<user_query:string,agent_response:string>>"


def _zipped(users: Column, agents: Column) -> Column:
    """The i-th question with the i-th answer, as far as there are both."""
    both = F.filter(F.arrays_zip(users.alias("user_query"), agents.alias("agent_response")), lambda p: p["user_query"].isNotNull() & p["agent_response"].isNotNull())
    return F.transform(both, lambda p: F.struct(p["user_query"].alias("user_query"), p["agent_response"].alias("agent_response")))


def _preloaded(html: Column) -> Column:
    """Of a page's preloaded state: each answer with the last question before it, if that has none yet."""
    state = F.regexp_extract(html, r"(?s)__PRELOADED_STATE__\s*=\s*(\{.*?\});", 1)
    messages = F.from_json(state, "chat struct<messages:array<struct<sender:string,text:string>>>")["chat"]["messages"]
    start = F.struct(F.lit("").alias("asked"), F.array().cast(_PAIRS).alias("pairs"))
    text = lambda m: F.coalesce(m["text"], F.lit(""))

    def step(state: Column, m: Column) -> Column:
        pair = F.struct(state["asked"].alias("user_query"), text(m).alias("agent_response"))
        human = F.struct(text(m).alias("asked"), state["pairs"].alias("pairs"))
        answer = F.struct(F.lit("").alias("asked"), F.concat(state["pairs"], F.array(pair)).alias("pairs"))
        return F.when(m["sender"] == "human", human).when(m["sender"] == "assistant", answer).otherwise(state)

    return F.coalesce(F.aggregate(messages, start, step, lambda s: s["pairs"]), F.array().cast(_PAIRS))


def chat_pairs(html: Column, url: Column, source_url: Column | None = None) -> Column:
    """(provider, method, pairs): by message attributes, preloaded state or class names; of unknown pages their long paragraphs as one answer of
    10,000 characters at most. A message is its whole element, whatever is nested in it, and nothing behind it."""
    name = provider(url, source_url) if source_url is not None else provider(url)
    messages = page_messages(html, name)
    none = F.array().cast(_PAIRS)
    texts = page_paragraphs(F.when(name == "unknown", html))
    fallback = F.array(F.struct(F.lit("Extracted text from link").alias("user_query"), F.substring(F.array_join(texts, "\n\n"), 1, 10_000).alias("agent_response")))
    pairs = F.when(name.isin("chatgpt", "gemini"), _zipped(messages["users"], messages["agents"])).when(name == "claude", _preloaded(html)).otherwise(F.when(F.size(texts) > 0, fallback).otherwise(none))
    pairs = F.coalesce(pairs, none)
    method = F.when(F.size(pairs) == 0, "none").when(name == "claude", "structured").when(name == "unknown", "fallback").otherwise("dom")
    return F.struct(name.alias("provider"), method.alias("method"), pairs.alias("pairs"))
