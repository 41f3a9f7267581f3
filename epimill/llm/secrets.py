"""Secrets found by regular expressions behind a trigram index; DataFrame functions only.

Each rule's expression gives a Boolean query over trigrams that any match must contain. The
trigrams of these queries are indexed: a posting list for each trigram and segment of
documents. Intersecting and uniting the lists gives each rule's candidates, in which the
expression is then looked for. A rule without mandatory trigrams looks at every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epimill.llm.common import fresh, n_partitions, stored

SEGMENT_DOCS = 1 << 16
MOST_STRINGS = 16
MOST_OF_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The kinds of secrets that are looked for.
BASE_RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)
RULES = BASE_RULES + MORE_RULES

# A query: all of its clauses; a clause: any of its sets; a set: all of its trigrams.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """What any match of the expression contains, in lower case. No clause: nothing is mandatory."""
    parser = re._parser  # the standard library's own parse of the expression
    query: Query = []

    def close(strings: set[str]) -> set[str]:
        """Turn the strings that may stand here into a clause, and start anew."""
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        if all(sets):
            query.append(sorted(set(sets), key=sorted))
        return {""}

    def strings_of(items: list) -> set[str] | None:
        """All strings that a part of the expression may match, if they are few."""
        found = {""}
        for item in items:
            own = of_item(item)
            if own is None or len(found) * len(own) > MOST_STRINGS:
                return None
            found = {a + b for a, b in product(found, own)}
        return found

    def of_item(item: tuple) -> set[str] | None:
        kind, value = str(item[0]), item[1]
        if kind == "LITERAL":
            return {chr(value).lower()}
        if kind == "IN":
            chars: set[str] = set()
            for inner, at in value:
                if str(inner) == "LITERAL":
                    chars.add(chr(at).lower())
                elif str(inner) == "RANGE" and at[1] - at[0] < MOST_OF_CLASS:
                    chars |= {chr(c).lower() for c in range(at[0], at[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= MOST_OF_CLASS else None
        if kind == "SUBPATTERN":
            return strings_of(list(value[3]))
        if kind == "BRANCH":
            parts = [strings_of(list(part)) for part in value[1]]
            return None if None in parts else set().union(*parts)
        if kind == "MAX_REPEAT" and value[1] == 1:
            own = strings_of(list(value[2]))
            return None if own is None else own if value[0] else own | {""}
        if kind == "MAX_REPEAT" and value[0] == value[1] <= 4:
            return strings_of(list(value[2]) * int(value[0]))
        return None

    strings = {""}
    for item in parser.parse(pattern):
        own = of_item(item)
        if own is None:
            strings = close(strings)
        elif len(strings) * len(own) > MOST_STRINGS:
            strings = close(strings)
            if len(own) <= MOST_STRINGS:
                strings = own
        else:
            strings = {a + b for a, b in product(strings, own)}
    close(strings)
    return query


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """(doc, kinds): by a hash of the key, the kinds whose trigram query a document meets.

    Documents are indexed in segments of bounded size; a posting list holds the documents of
    one segment, and all lists of a segment stand in one row.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    lowered = fresh(docs, "lowered")
    doc = F.xxhash64(f"`{key}`")
    n_segments = max(1, n_partitions(docs.sparkSession, docs.count(), SEGMENT_DOCS))
    present = F.array_compact(F.array(*[F.when(F.contains(F.col(lowered), F.lit(t)), F.lit(t)) for t in trigrams]))
    seen = docs.select(doc.alias("doc"), F.lower(f"`{text}`").alias(lowered)).select("doc", F.explode(present).alias("trigram"))
    postings = seen.groupBy(F.pmod("doc", F.lit(n_segments)).alias("segment"), "trigram").agg(
        F.collect_set("doc").alias("docs")
    )
    entry = F.struct("trigram", "docs")
    segments = postings.groupBy("segment").agg(F.map_from_entries(F.collect_list(entry)).alias("postings"))

    def listed(trigram: str) -> Column:
        return F.coalesce(F.col("postings")[trigram], F.array().cast("array<bigint>"))

    def meets(query: Query) -> Column:
        clauses = [
            reduce(F.array_union, [reduce(F.array_intersect, [listed(t) for t in sorted(s)]) for s in clause])
            for clause in query
        ]
        return reduce(F.array_intersect, clauses)

    found = F.array(*[F.struct(F.lit(kind).alias("kind"), meets(q).alias("docs")) for kind, q in queries.items()])
    pairs = segments.select(F.explode(found).alias("found")).select("found.kind", F.explode("found.docs").alias("doc"))
    return pairs.groupBy("doc").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def spans_of(rule: Rule, number: int, text: Column) -> Column:
    """Leftmost non-overlapping matches as (start, kind number, kind, end), in code points.

    The texts between matches and the matches alternate, which gives the places. A match
    whose group is too short is dropped, but has used up its characters.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, 0)
    measured = F.regexp_extract_all(text, pattern, rule.group) if rule.group else matches
    parts = F.arrays_zip(matches.alias("match"), measured.alias("measured"), F.split(text, rule.pattern, -1).alias("gap"))
    kind = "array<struct<start:int,number:int,kind:string,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(
            begin.alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), end.alias("end")
        )
        long_enough = F.coalesce(F.length(part["measured"]) >= rule.least, F.lit(False))
        found = F.when(long_enough, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(parts, start, step, lambda state: state["found"])


def quick_pattern(rule: Rule) -> str | None:
    """For a single repeated class, an expression that only texts with a long enough match contain."""
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^\]]*\]\+", rule.pattern) else None


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", spans: str = "spans"
) -> DataFrame:
    """``docs`` with the array ``spans`` of (start, kind, end): code points, end exclusive.

    Spans are ordered by start, then by the rules' order; spans of several kinds may overlap.
    Null and empty texts have none. Rows with equal or null keys are told apart only in the
    index, where each of them is a candidate if one is. A column called ``spans`` is replaced.
    """
    found = stored(candidates(docs, rules, key, text), "secret-candidates")
    doc, kinds, of_kind = (fresh(docs, c) for c in ("doc", "kinds", "of_kind"))
    found = found.select(F.col("doc").alias(doc), F.col("kinds").alias(kinds))
    column = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    joined = docs.withColumn(doc, F.xxhash64(f"`{key}`")).join(found, doc, "left")
    empty = F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")
    per_rule = []
    for number, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            wanted = F.array_contains(F.col(kinds), rule.kind)
        else:
            wanted = column.rlike(quick_pattern(rule) or rule.pattern)
        per_rule.append(F.when(wanted, spans_of(rule, number, column)).otherwise(empty))
    ordered = joined.withColumn(of_kind, F.array_sort(F.concat(*per_rule)))
    bare = F.transform(F.col(of_kind), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != spans.lower()]
    return ordered.select(*kept, bare.alias(spans))


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        apart = F.concat(state["out"], gap, F.lit(mark))
        return F.struct(
            F.when(span["start"] >= state["at"], apart).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
