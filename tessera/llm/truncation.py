"""Texts cut off by field limits or broken transfers.

Two passes over all texts collect the corpus evidence:

* the vocabulary of words inside texts (a text's last word doesn't count) and its trie, held as a
  table with one row per node, the node being its prefix;
* for each context before a place (the line so far, or up to five tokens), how often a sentence ends,
  goes on or the text ends there. Words of many documents stand for themselves, numbers and rare words
  for their class.

A text is judged by its end: a last word that is unknown and a proper prefix of known words was cut;
an end in a context where sentences go on lies within a sentence; a length at which the source's
lengths pile up is a field limit. Teaser marks and torn markup are taken off first and count as evidence.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import load, materialise

COMMON_SHARE = 0.001  # a word of this share of the documents stands for itself
FLUSH = 200_000
MIN_SEEN = 3
WITHIN = 0.35  # below this share of ends, an end lies within a sentence
NATURAL = 0.9
# Months, after which a number with a full stop was a date's day.
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Marks that teasers end with.
MARK = re.compile(r"\s*(?:\[(?:\.\.\.|…|mehr|more)\]|\((?:mehr|more)\)|…|\.\.\.)\s*$")
# Tags begin with a letter, a slash or an exclamation mark right behind the bracket; a bracket before a blank is a sign.
ANY_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
TORN_TAG = re.compile(r"<(?:/?[a-zA-Z][\w-]*(?:\s+(?:[^<>]*=[^<>]*|[\w-]*))?|/|!-{0,2}[^<>]*)?")
ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);")
ENTITIES = frozenset(n[:k] for n in name2codepoint for k in range(1, len(n) + 1))
TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+(?:[.,:/]\d+)*|\n|[^\w\s]")
STOPS = frozenset(".!?")
OPEN_END = frozenset(",:;-–/(„&+")
START = "^"
SEP = "\x1f"
LONG = 64
REACH = 1000  # characters at a text's end that are looked at first
LINE = 14  # lines of at most this many tokens are contexts themselves
ORDERS = (5, 3, 2, 1)  # tokens of the other contexts, longest first
LINE_1, LINE_2, LINE_3 = (SEP.join([START] * n) + SEP for n in (2, 3, 4))  # what the three forms of a line begin with


def torn_at(text: str) -> int:
    """Where torn markup at a text's end begins: a tag or entity that isn't finished, or broken characters; -1 if there is none."""
    if text.endswith("\ufffd"):
        return len(text.rstrip("\ufffd"))
    i = text.rfind("<")
    if i >= 0 and TORN_TAG.fullmatch(text, i):
        return i
    i = text.rfind("&")
    name = text[i + 1 :] if i >= 0 else "?"
    # A single capital letter behind the sign is an abbreviation, as in R&D.
    if not name or name in ENTITIES and not (len(name) == 1 and name.isupper()) or name[0] == "#" and name[1:].isalnum() or name == "#":
        return i
    return -1


def clean_tail(text: str) -> tuple[str, bool, bool]:
    """Text without tags, teaser marks and torn markup at its end; whether there was a mark, or torn markup."""
    text, mark, torn = text.rstrip(), False, False
    while text:
        i = text.rfind("<") if text[-1] == ">" else text.rfind("&") if text[-1] == ";" else -1
        if i >= 0 and (ANY_TAG if text[-1] == ">" else ENTITY).fullmatch(text, i):
            pass
        elif m := MARK.search(text, max(0, len(text) - 40)):
            mark, i = True, m.start()
        elif (i := torn_at(text)) >= 0:
            torn = True
        else:
            break
        text = text[:i].rstrip()
    return text, mark, torn


def plain(text: str) -> str:
    """Text without markup: tags become blanks, entities their characters."""
    return html.unescape(ANY_TAG.sub(" ", text)) if "<" in text or "&" in text else text


def tail_of(text: str) -> str:
    """The end of a plain text that gives the same contexts as the whole: with a line break, or more tokens than a line that counts has."""
    reach = REACH
    while reach < len(text):
        at = len(text) - reach
        # Neither a word, an entity nor a tag is taken apart.
        at = max(text.rfind(" ", 0, at + 1), text.rfind("\n", 0, at + 1), 0)
        tag = ANY_TAG.match(text, i) if (i := text.rfind("<", 0, at)) >= 0 else None
        out = plain(text[i if tag and tag.end() > at else at :])
        tokens = TOKEN.findall(out)
        if "\n" in tokens or len(tokens) > LINE + 2:
            return out
        reach *= 2
    return plain(text)


def word_class(word: str, common: frozenset[str]) -> str:
    if word[0].isdigit():
        return "0"
    return word if word in common else ("X" if word[0].isupper() else "x")


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, docs, last = Counter(), Counter(), Counter()

    def out() -> pd.DataFrame:
        every = list(docs | last)
        x = pd.DataFrame({"word": every, "n": [n[w] for w in every], "docs": [docs[w] for w in every], "last": [last[w] for w in every]})
        for c in (n, docs, last):
            c.clear()
        return x

    for b in batches:
        for text in b["text"]:
            words = [t for t in TOKEN.findall(plain(clean_tail(text)[0])) if t[0].isalpha()]
            n.update(words[:-1])
            docs.update(set(words[:-1]))
            last.update(words[-1:])
            if len(docs) + len(last) > FLUSH:
                yield out()
    if docs or last:
        yield out()


def vocabulary(texts: DataFrame) -> DataFrame:
    """``word, n, docs, last``: occurrences before a text's last word, the documents with them, and texts that end in the word."""
    return texts.select("text").mapInPandas(_words, "word string, n long, docs long, last long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "docs", "last")])


def trie(words: DataFrame, frequent: Column) -> DataFrame:
    """Nodes of the vocabulary's trie: ``prefix``, ``below``, the number of known words it is a proper prefix of, and how many of these are ``frequent``.

    Of words of more than ``LONG`` letters only the nodes as long as some text's last word are made: no other is ever asked for.
    """
    ends = [r[0] for r in words.filter("last > 0").select(F.length("word").alias("n")).distinct().collect()]  # as many as there are lengths
    known = words.filter("n > 0 and length(word) >= 2").withColumn("often", frequent)
    n = F.length("word")
    asked = F.filter(F.array(*[F.lit(k) for k in sorted(ends)]).cast("array<int>"), lambda k: k < n)
    depths = F.when(n <= LONG, F.sequence(F.lit(1), n - 1)).otherwise(asked)
    prefixes = known.select(F.explode(F.transform(depths, lambda i: F.substring("word", F.lit(1), i))).alias("prefix"), "often")
    return prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("below"), F.count(F.when(F.col("often"), 1)).alias("frequent"))


def often(docs: Column, total: int) -> Column:
    """Whether a share of ``COMMON_SHARE`` of the documents is reached, one standard deviation of the count aside."""
    return docs - F.sqrt(docs) >= COMMON_SHARE * total


def places(text: str, common: frozenset[str]) -> Iterator[tuple[list[str], list[str] | None, str, str]]:
    """(last tokens, line so far if short, class of the word, what follows: ``end``, ``on`` or ``eot``) for each word."""
    tokens = TOKEN.findall(text)
    line, sentence = [], [START]
    for i, t in enumerate(tokens):
        if t == "\n":
            line, sentence = [], [START]
            continue
        word = t[0].isalnum()
        c = word_class(t, common) if word else t
        line.append(c)
        sentence.append(c)
        if not word:
            if t in STOPS and i and not tokens[i - 1][0].isdigit():
                sentence = [START]
            continue
        nxt = tokens[i + 1] if i + 1 < len(tokens) else None
        if nxt is None:
            what = "eot"
        elif nxt == "." and c == "0":
            what = "on" if i + 2 < len(tokens) and tokens[i + 2] in MONTHS else "end"
        elif nxt in STOPS or nxt == "\n":
            what = "end"
        elif nxt[0].isalnum() or nxt in OPEN_END:
            what = "on"
        else:
            continue
        yield sentence, line if len(line) <= LINE else None, c, what


def keys_of(sentence: list[str], line: list[str] | None) -> list[str | None]:
    """The contexts of a place, longest first: the line so far, then the last tokens of the sentence."""
    if line:
        # Names change from line to line: in the second form every capitalised word but the first is one class.
        named = [line[0], *["X" if w[0].isalpha() and w[0].isupper() else w for w in line[1:]]]
        first = "X" if line[0][0].isupper() else line[0]
        lines = [SEP.join([START, START, *line]), SEP.join([START, START, START, *named]), SEP.join([START, START, START, START, first, *named[1:]])]
    else:
        lines = [None, None, None]
    return [*lines, *[SEP.join(sentence[-k:]) if len(sentence) >= k else None for k in ORDERS]]


def tally(text: str, common: frozenset[str], seen: dict[str, list[int]]) -> None:
    """Adds to ``seen`` the ends (0) and continuations (1) of every context of a text.

    The same contexts as ``keys_of`` gives for ``places``, built up from token to token instead of anew for each.
    """
    tokens = TOKEN.findall(text)
    tokens.append("")
    # The last one, two, three and four tokens of the sentence, joined; the line in its three forms.
    s1, s2, s3, s4 = START, None, None, None
    n, exact, named, every = 0, "", "", ""
    before_digit = False
    for i in range(len(tokens) - 1):
        t = tokens[i]
        if t == "\n":
            s1, s2, s3, s4 = START, None, None, None
            n = 0
            before_digit = False
            continue
        h = t[0]
        word = h.isalnum()
        c = t if not word or t in common else "0" if h.isdigit() else "X" if h.isupper() else "x"
        n += 1
        if n == 1:
            exact, named, every = LINE_1 + c, LINE_2 + c, LINE_3 + ("X" if c[0].isupper() else c)
        elif n <= LINE:
            g = "X" if c[0].isupper() else c
            exact, named, every = exact + SEP + c, named + SEP + g, every + SEP + g
        k2 = s1 + SEP + c
        k3 = s2 and s2 + SEP + c
        k4 = s3 and s3 + SEP + c
        if word:
            nxt = tokens[i + 1]
            if not nxt:
                at = -1
            elif nxt == "." and c == "0":
                at = 1 if tokens[i + 2] in MONTHS else 0
            elif nxt in STOPS or nxt == "\n":
                at = 0
            elif nxt[0].isalnum() or nxt in OPEN_END:
                at = 1
            else:
                at = -1
            if at >= 0:
                for k in (c, k2, k3, s4 and s4 + SEP + c) if n > LINE else (c, k2, k3, s4 and s4 + SEP + c, exact, named, every):
                    if k:
                        v = seen.get(k)
                        if v is None:
                            v = seen[k] = [0, 0]
                        v[at] += 1
            s1, s2, s3, s4 = c, k2, k3, k4
        elif t in STOPS and i and not before_digit:
            s1, s2, s3, s4 = START, None, None, None
        else:
            s1, s2, s3, s4 = c, k2, k3, k4
        before_digit = h.isdigit()


def contexts(texts: DataFrame, common: frozenset[str], ended: DataFrame) -> DataFrame:
    """``context, n_end, n_on, n_eot`` for every context in the texts.

    ``ended``: the tails whose last word is a known one; of others the text may have ended in a word cut
    short, which says nothing about where texts end.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            x = pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["context", "n_end", "n_on"])
            seen.clear()
            return x

        for b in batches:
            for text in b["text"]:
                tally(plain(clean_tail(text)[0]), common, seen)
                if len(seen) > FLUSH:
                    yield out()
        if seen:
            yield out()

    parts = texts.select("text").mapInPandas(count, "context string, n_end long, n_on long").withColumn("n_eot", F.lit(0).cast("long"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = ended.select(F.explode(F.filter(F.array(*CONTEXTS), lambda k: k.isNotNull())).alias("context"), zero.alias("n_end"), zero.alias("n_on"), one.alias("n_eot"))
    parts = parts.unionByName(ends)
    return parts.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("n_end", "n_on", "n_eot")])


CONTEXTS = [f"c{i}" for i in range(len(ORDERS) + 3)]
TAIL = "doc_id string, source string, n_chars long, n_bytes long, last string, word boolean, closed boolean, ordinal boolean, open_end boolean, empty boolean, mark boolean, torn boolean, " + ", ".join(f"{c} string" for c in CONTEXTS)


def tails(texts: DataFrame, common: frozenset[str]) -> DataFrame:
    """What each text ends with; ``c0``-``c6`` are its contexts, ``last`` its last word if the text ends in one."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, source, text in zip(b["doc_id"], b["source"], b["text"], strict=True):
                cleaned, mark, torn = clean_tail(text)
                # The contexts reach back at most one line or LINE tokens: what lies before can't change them.
                cleaned = tail_of(cleaned)
                tokens = TOKEN.findall(cleaned)
                ends = tokens[-1] if tokens else ""
                number = len(tokens) > 1 and ends == "." and tokens[-2][0].isdigit()
                word = ends[:1].isalnum()
                sentence, line, c = [], None, ""
                for sentence, line, c, _ in places(cleaned[:-1] if number else cleaned, common):
                    sentence = list(sentence)
                keys = keys_of(sentence, line) if sentence and (word or number) else [None] * len(CONTEXTS)
                closed = bool(ends) and not word and not number and ends not in OPEN_END
                rows.append((doc_id, source, len(text), len(text.rstrip("\ufffd").encode("utf-8", "replace")), ends if ends[:1].isalpha() else None, word, closed, number, ends in OPEN_END, not ends, mark, torn, *keys))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TAIL.split(", ")])

    # As text, since a null would turn a batch's ids into floating-point numbers.
    t = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text").mapInPandas(of, TAIL)
    return t.withColumn("doc_id", F.col("doc_id").cast(texts.schema["doc_id"].dataType))


def field_limits(ends: DataFrame, within: int = 20, least: int = 5, times: float = 5.0, cut: float = 0.3) -> DataFrame:
    """``source, n_chars`` at which texts pile up and are cut.

    ``ends``: ``source, n_chars, is_cut``. At least ``least`` texts have the length, ``times`` as many
    as the mean of the lengths around, and a share of ``cut`` of them shows a cut by itself. From the histogram of lengths over
    all documents, which is as long as there are distinct lengths.
    """
    h = ends.groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_cut").cast("double")).alias("cut"))
    near = h.select("source", F.explode(F.sequence(F.col("n_chars") - within, F.col("n_chars") + within)).alias("n_chars"), "n").groupBy("source", "n_chars").agg(F.sum("n").alias("around"))
    mean = (F.col("around") - F.col("n")) / (2.0 * within)
    return h.join(near, ["source", "n_chars"]).filter((F.col("n") >= least) & (F.col("n") > times * F.greatest(mean, F.lit(0.5))) & (F.col("cut") >= cut)).select("source", "n_chars")


def judge(documents: DataFrame) -> DataFrame:
    """``doc_id, source, truncated, reason, end_share`` for each document; ``documents``: ``doc_id, source, text``.

    A null or empty text isn't truncated. Null sources are a source of their own. Repeated rows and
    documents are judged each by itself. Texts are read whole, however long.
    """
    docs = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    words = materialise(vocabulary(docs), "words")
    total = docs.count()
    # A document has few distinct words, so the words of COMMON_SHARE of the documents are few: at most
    # (mean distinct words of a document) / COMMON_SHARE.
    nodes = materialise(trie(words, often(F.col("docs"), total)), "trie")
    # Words that only end texts count too, unless they are prefixes of others and so may be cut.
    named = words.filter(~often(F.col("docs"), total) & often(F.col("docs") + F.col("last"), total)).join(nodes, F.col("word") == F.col("prefix"), "left_anti")
    common = frozenset(r[0] for r in words.filter(often(F.col("docs"), total)).select("word").unionByName(named.select("word")).toLocalIterator())
    t = tails(docs, common).join(words.select(F.col("word").alias("last"), F.col("n").alias("known")), "last", "left").join(nodes.withColumnRenamed("prefix", "last"), "last", "left")
    unknown = F.col("last").isNotNull() & (F.coalesce("known", F.lit(0)) == 0)
    t = t.withColumn("cut_word", unknown & (F.coalesce("below", F.lit(0)) > 0))
    # Whether the end is one of a whole word, and so counts among the ends of its contexts.
    t = materialise(t.withColumn("whole", F.col("word") & ~F.col("cut_word")), "tails")
    ctx = materialise(contexts(docs, common, t.filter("whole")), "contexts")
    for k in CONTEXTS:
        t = t.join(ctx.select(F.col("context").alias(k), F.struct("n_end", "n_on", "n_eot").alias(f"{k}_n")), k, "left")

    # Of the contexts seen often enough beside this text itself, the longest speaks.
    own = F.col("whole").cast("int")
    others = lambda k: F.col(f"{k}_n.n_end") + F.col(f"{k}_n.n_on") + F.col(f"{k}_n.n_eot") - own
    ends = lambda k: (F.col(f"{k}_n.n_end") + F.col(f"{k}_n.n_eot") - own) / others(k)
    share = F.coalesce(*[F.when(others(k) >= MIN_SEEN, ends(k)) for k in CONTEXTS])
    t = t.withColumn("share", share)
    # An unknown name may end a text where names do, e.g. a title; other unknown words don't, nor do beginnings of common ones.
    natural = (F.coalesce("share", F.lit(0.0)) >= NATURAL) & F.col("last").rlike(r"^\p{Lu}") & (F.coalesce("frequent", F.lit(0)) == 0) & ~F.col("mark") & ~F.col("torn")
    t = t.withColumn(
        "reason",
        F.when(F.col("empty") | F.col("closed"), None)
        .when(F.col("open_end"), "open end")
        .when(F.col("cut_word") & ~natural, "cut word")
        .when(F.col("share") < WITHIN, "within a sentence")
        .when(F.col("share").isNull() & (F.col("mark") | F.col("torn")), "mark"),
    )
    # A field may be limited in characters or in bytes.
    t = materialise(t.drop(*CONTEXTS, *[f"{k}_n" for k in CONTEXTS]), "judged")
    for unit in ("n_chars", "n_bytes"):
        limits = field_limits(t.select("source", F.col(unit).alias("n_chars"), F.col("reason").isNotNull().alias("is_cut"))).select("source", F.col("n_chars").alias(unit), F.lit(True).alias(f"at_{unit}"))
        t = t.join(limits, ["source", unit], "left")
    t = t.withColumn("at_limit", F.coalesce("at_n_chars", "at_n_bytes"))
    reason = F.when(F.col("at_limit") & (F.col("reason").isNotNull() | ~(F.col("empty") | F.col("closed") | F.col("ordinal"))), "field limit").otherwise(F.col("reason"))
    return t.select("doc_id", "source", reason.isNotNull().alias("truncated"), reason.alias("reason"), F.col("share").alias("end_share"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents")).filter("truncated and doc_id is not null").select("doc_id").distinct()


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, truncated documents and their share, and the reasons."""
    j = judge(load(spark, sf_dir, "documents"))
    n = lambda r: F.count(F.when(F.col("reason") == r, 1))
    return j.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("truncated"), 1)).alias("truncated"), F.round(F.avg(F.col("truncated").cast("double")), 4).alias("rate"),
        n("field limit").alias("at_field_limit"), n("cut word").alias("cut_word"), (n("within a sentence") + n("open end") + n("mark")).alias("within_sentence"),
    )
