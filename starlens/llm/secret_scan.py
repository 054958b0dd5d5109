"""Secret scans over a trigram inverted index, with DataFrame operations only.

From each rule's regular expression follows a Boolean query: some alternative whose literal trigrams all
occur in the lower-cased text.  The index holds postings (trigram, doc_id) for the trigrams of the rules;
intersecting them leaves the documents that a rule can match, and only there the expression itself runs.
Rules without mandatory trigrams are run on every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import texts_of

_parse = re._parser.parse  # the standard library's own reading of a pattern


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``at_least`` characters."""

    kind: str
    pattern: str
    at_least: int = 1
    group: int = 0


BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
# Further kinds of keys, with the fixed prefixes their issuers publish.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: Alternatives a query may have; beyond it a branching part counts as unknown, which only weakens the query.
MOST_ALTERNATIVES = 64


def _texts(parsed) -> list[tuple[str, ...]]:
    """Alternatives of literal pieces in order; between two pieces anything may stand."""
    known: list[tuple[str, ...]] = [("",)]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            part = [(chr(arg).lower(),)]
        elif name == "SUBPATTERN":
            part = _texts(arg[-1])
        elif name == "BRANCH":
            part = [t for branch in arg[1] for t in _texts(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            part = [("",), *_texts(arg[2])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            part = [(*t, "") if arg[1] > 1 else t for t in _texts(arg[2])]
        else:
            part = [("", "")]
        if len(part) * len(known) > MOST_ALTERNATIVES:
            part = [("", "")]
        known = list(dict.fromkeys((*a[:-1], a[-1] + b[0], *b[1:]) for a in known for b in part))
    return known


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives of trigrams that must all occur, or None if some match needs no trigram."""
    alternatives = [
        sorted({piece[i : i + 3] for piece in pieces for i in range(len(piece) - 2)}) for pieces in _texts(_parse(pattern))
    ]
    if any(not a for a in alternatives):
        return None
    return [list(a) for a in dict.fromkeys(map(tuple, alternatives))]


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id), one for each document and trigram of the list that its text holds."""
    d = texts_of(docs).filter("doc_id is not null and text is not null")
    d = d.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return d.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): documents that hold all trigrams of some alternative of a rule."""
    queries = [
        (r.kind, n, t, len(a)) for r in rules for n, a in enumerate(trigram_query(r.pattern) or []) for t in a
    ]
    table = index.sparkSession.createDataFrame(queries, "kind string, alternative int, trigram string, needed int")
    return (
        index.join(F.broadcast(table), "trigram")  # a row for each trigram of the rules
        .groupBy("doc_id", "kind", "alternative")
        .agg(F.count_distinct("trigram").alias("found"), F.first("needed").alias("needed"))
        .filter("found = needed")
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches of a rule from left to right as (start, rank, stop, kind), in code points."""
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        checked.alias("checked"),
    )
    empty = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    walked = F.aggregate(
        F.filter(pieces, lambda p: p["hit"].isNotNull()),
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
            F.when(
                F.length(p["checked"]) >= rule.at_least,
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(p["gap"])).alias("start"),
                            F.lit(order).alias("rank"),
                            (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("stop"),
                            F.lit(rule.kind).alias("kind"),
                        )
                    ),
                ),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(text.rlike(_worthwhile(rule)), walked).otherwise(empty)


def _worthwhile(rule: Rule) -> str:
    """A text without this has no match that passes: a run of one class is checked by its length at once."""
    run = re.fullmatch(r"([A-Za-z0-9]*)(\[[^\]]+\])\+", rule.pattern)
    if rule.group or not run:
        return rule.pattern
    return f"{run[1]}{run[2]}{{{max(1, rule.at_least - len(run[1]))},}}"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Per row: doc_id, n_<kind> of the first ``base`` rules, base_sha256, spans, found.

    ``spans`` joins kind:start:stop of all rules by start, then by the order of the rules; ``base_sha256``
    hashes the same of the first ``base`` rules.  Offsets are code points, the end exclusive; matches of one
    rule don't overlap, those of several may.  ``found`` has the spans as structs.

    Null is the empty text: no spans.  A row without id is checked by every rule.  Repeated rows each get
    their row; an empty table gives none; texts are scanned whole.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    trigrams = sorted({t for r in indexed for a in trigram_query(r.pattern) for t in a})
    d = texts_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        d = d.join(candidates(trigram_index(docs, trigrams), indexed), "doc_id", "left")
    else:
        d = d.withColumn("kinds", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    columns = []
    for k, rule in enumerate(rules):
        own = spans(F.col("text"), rule, k)
        if rule in indexed:
            may = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            own = F.when(may, own).otherwise(empty)
        columns.append(own.alias(f"s{k}"))
    d = d.select("doc_id", *columns)
    d = d.select(
        "doc_id",
        *(F.size(f"s{k}").cast("bigint").alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])),
        F.array_sort(F.concat(*(f"s{k}" for k in range(base)))).alias("own"),
        F.array_sort(F.concat(*(f"s{k}" for k in range(len(rules))))).alias("found"),
    )
    return d.select(
        "doc_id",
        *(f"n_{r.kind}" for r in rules[:base]),
        F.sha2(_line("own"), 256).alias("base_sha256"),
        _line("found").alias("spans"),
        "found",
    )


def _line(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
