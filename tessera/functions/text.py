"""Text: normalisation, trigram similarity, markup, classifiers, place mentions and minutes."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_TERM = 4


def normalize(c: Column) -> Column:
    """Lower case, ß as ss, white space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def trigrams(c: Column) -> Column:
    """The set of trigrams of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        p = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def set_similarity(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union; 0 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def strip_html(c: Column) -> Column:
    """Without tags, trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")), F.lit(""))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Entities to characters: no built-in does it."""
    return s.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)


# Line breaks, ends of blocks, and tags.
BREAK, BLOCK_END, ANY_TAG = r"(?i)<br\s*/?>", r"(?i)</(p|div|tr|td|font|li|h\d)>", "<[^>]+>"


def html_to_text(c: Column) -> Column:
    """Line breaks and block ends become new lines, other tags vanish, entities are resolved."""
    lines = F.regexp_replace(F.regexp_replace(c, BREAK, "\n"), BLOCK_END, "\n")
    return unescape(F.regexp_replace(lines, ANY_TAG, ""))


# Classes of police reports and the words that make them, first match wins.
REPORT_CLASSES = (
    ("demonstration", ("versammlung", "demonstration", "kundgebung", "aufzug")),
    ("traffic_accident", ("unfall", "verkehr", "kollision")),
    ("police_operation", ("razzia", "durchsuchung", "festnahme")),
)


def classify_report(title: Column, description: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    out = F.lit("police_report")
    for name, words in reversed(REPORT_CLASSES):
        out = F.when(blob.rlike("|".join(words)), name).otherwise(out)
    return out


# The properties whose text is scanned for places.
TEXT_KEYS = ("gremium", "title", "description", "reason", "subtitle")


def node_text(label: Column, properties: Column) -> Column:
    """Label and the string values of the text properties, joined by blanks."""
    v = F.try_parse_json(properties)
    parts = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in TEXT_KEYS]
    return F.concat_ws(" ", label, *parts)


def gazetteer(layers: list[tuple[DataFrame, str]]) -> DataFrame:
    """``term, node_id, relation`` from layers of ``ord, id, label``; a later layer overrides an earlier one.

    In the first layer the first of equal terms counts, in a later one the last. Terms below four characters are left out.
    """
    every = None
    for i, (rows, relation) in enumerate(layers):
        rank = F.col("ord") if i == 0 else -F.col("ord")
        x = rows.select(normalize(F.col("label")).alias("term"), F.struct(F.lit(-i).alias("layer"), rank.alias("rank"), F.col("id").alias("node_id"), F.lit(relation).alias("relation")).alias("e"))
        every = x if every is None else every.unionByName(x)
    return every.filter(F.length("term") >= MIN_TERM).groupBy("term").agg(F.min("e").alias("e")).select("term", "e.node_id", "e.relation")


def mentions(texts: DataFrame, terms: DataFrame, max_words: int | None = None) -> DataFrame:
    """``id, term, node_id, relation``: distinct gazetteer terms in each text, leftmost and longest first.

    ``texts``: ``id, text``; ids are unique. Each run of up to ``max_words`` words is looked up by an equi-join, so the
    cost doesn't grow with the gazetteer as an alternation's would. Matches that overlap an earlier one
    drop out. ``max_words`` is by default the longest term's number of words; terms start and end in word characters.
    """
    if max_words is None:
        words = F.size(F.regexp_extract_all("term", F.lit(r"(?U)\w+"), F.lit(0)))
        max_words = terms.agg(F.max(words)).first()[0] or 1
    tokens = F.regexp_extract_all(normalize(F.col("text")), F.lit(r"(?U)(\w+|[^\w]+)"), F.lit(1))
    t = texts.select("id", tokens.alias("tokens"))
    is_word = lambda x: x.rlike(r"(?U)^\w")
    starts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens"), F.lit(1))), lambda i: F.when(is_word(F.get("tokens", i - 1)), i)), lambda i: i.isNotNull())
    lengths = F.array(*[F.lit(2 * k + 1) for k in range(max_words)])
    spans = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(lengths, lambda n: i + n - 1 <= F.size("tokens")), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("tokens", i, n), "").alias("term")))))
    hits = t.select("id", F.explode(spans).alias("s")).select("id", "s.*").join(terms, "term")
    found = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("short"), "term", "node_id", "relation"))).alias("found"))
    none = F.struct(F.lit(0).alias("until"), F.slice("found", 1, 0).alias("kept"))
    kept = F.aggregate("found", none, lambda acc, m: F.when(m["at"] > acc["until"], F.struct((m["at"] - m["short"] - 1).alias("until"), F.concat(acc["kept"], F.array(m)).alias("kept"))).otherwise(acc))
    return found.select("id", F.explode(kept["kept"]).alias("m")).select("id", "m.term", "m.node_id", "m.relation").distinct()


# Patterns of council minutes and words of decisions.
PAPER = r"(?i)(?:Dr\.|Drucksache)\s*Nr\.?:?\s*(\d{3,}-\d{2})"
ITEM = r"^(\d+(?:\.\d+){0,3})\s+(\S.*)$"
OUTCOME = r"(?i)(einstimmig|mehrheitlich|abgelehnt|zugestimmt|genehmigt|beschlossen)"
OUTCOME_REACH, TITLE_LENGTH, NUMBER_LENGTH = 250, 200, 10
ITEM_MARK, LINE_MARK = "\x01", "\x02"


def decisions(text: Column) -> Column:
    """``array<struct<nr, vote>>``: each mention of a paper with the outcome said behind it, null if none is.

    The text between two numbers belongs to the former; of it, its first sentence counts, within ``OUTCOME_REACH`` characters.
    """
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    behind = F.slice(F.split(flat, PAPER), 2, 1 << 30)
    said = F.transform(behind, lambda t: F.nullif(F.lower(F.regexp_extract(F.substring_index(F.substring(t, 1, OUTCOME_REACH), ". ", 1), OUTCOME, 1)), F.lit("")))
    return F.zip_with(F.regexp_extract_all(flat, F.lit(PAPER), F.lit(1)), said, lambda nr, vote: F.struct(nr.alias("nr"), vote.alias("vote")))


def parse_minutes(text: Column) -> Column:
    """Agenda of minutes: ``array<struct<number, title, papers array<struct<nr, vote, passed>>>>``; of null it is empty.

    A line that begins with a number opens an item, which lasts to the next one. A paper's outcome is the first that is
    said behind any of its mentions; ``passed`` is null where none is.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), ITEM_MARK + LINE_MARK, "")
    lines = F.transform(F.split(clean, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    opens = lambda t: t.rlike(ITEM) & (F.length(F.regexp_extract(t, ITEM, 1)) <= NUMBER_LENGTH)
    marked = F.array_join(F.transform(lines, lambda t: F.when(opens(t), F.concat(F.lit(ITEM_MARK), t)).otherwise(t)), LINE_MARK)

    def paper(said: Column, nr: Column) -> Column:
        vote = F.get(F.filter(said, lambda d: d["nr"] == nr), F.lit(0))["vote"]
        return F.struct(nr.alias("nr"), vote.alias("vote"), (vote != "abgelehnt").alias("passed"))

    def item(said: Column, part: Column) -> Column:
        head = F.substring_index(part, LINE_MARK, 1)
        papers = F.array_sort(F.array_distinct(F.regexp_extract_all(part, F.lit(PAPER), F.lit(1))))
        return F.struct(F.regexp_extract(head, ITEM, 1).alias("number"), F.substring(F.regexp_extract(head, ITEM, 2), 1, TITLE_LENGTH).alias("title"), F.transform(papers, lambda nr: paper(said, nr)).alias("papers"))

    # The outcomes are a lambda variable, so they're made once a text and not once a paper.
    once = F.array(F.filter(decisions(clean), lambda d: d["vote"].isNotNull()))
    return F.transform(once, lambda said: F.transform(F.slice(F.split(marked, ITEM_MARK), 2, 1 << 30), lambda part: item(said, part)))[0]


def _insights(raw: str | None) -> list[str]:
    """The JSON objects of a model's answer: a list, an object with ``insights``, fenced or with noise around."""
    text = (raw or "").strip()
    if fenced := re.match(r"```(?:\s*json)?(.*?)(?:```|$)", text, re.I | re.S):
        text = fenced.group(1)
    for attempt in (text, text[max(text.find("{"), 0) : text.rfind("}") + 1]):
        try:
            data = json.loads(attempt)
        except ValueError:
            continue
        items = data if isinstance(data, list) else data.get("insights", []) if isinstance(data, dict) else []
        return [json.dumps(d, sort_keys=True, ensure_ascii=False) for d in items if isinstance(d, dict)] if isinstance(items, list) else []
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_insights(s: pd.Series) -> pd.Series:
    return s.map(_insights)


def derive_title(title: Column, description: Column) -> Column:
    """The title, else the description's first sentence, else a fixed word; at most 200 characters."""
    first = F.get(F.split(F.trim(F.coalesce(description, F.lit(""))), r"\. "), F.lit(0))
    return F.substring(F.coalesce(F.nullif(title, F.lit("")), F.nullif(first, F.lit("")), F.lit("Insight")), 1, 200)
