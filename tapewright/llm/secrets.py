"""Secret scans (operator 9): a trigram inverted index, native DataFrame functions only.

Each rule is a regular expression. From its parse tree follows a Boolean query over trigrams: alternatives of sets of
trigrams that every match must contain. The index has a posting (trigram, row key) for each trigram of these queries
that a text holds; postings are intersected per key, and only rows that fulfil a rule's query are searched with its
expression. Rules without a mandatory trigram search every row. Keys are hashes of id and text: rows that share a key
only share postings, so that a collision can cost time, not results.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import free_name

Query = frozenset  # of frozensets of trigrams: one of the sets must be there in whole
ANY: Query = frozenset([frozenset()])
#: Strings that a part of an expression is spelled out into, and alternatives that a query may have; beyond it is ANY.
MOST = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value_group: int = 0  # the group whose length counts
    least: int = 0  # shorter matches are dropped


#: Fixed values. The first three are the base kinds; order is the order of kinds at one place.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")


# --- queries from expressions -----------------------------------------------------------


def _reduced(query) -> Query:
    """Without alternatives that contain another one."""
    kept: list[frozenset] = []
    for grams in sorted(query, key=len):
        if not any(k <= grams for k in kept):
            kept.append(grams)
    return frozenset(kept) if 0 < len(kept) <= MOST else ANY


def _both(a: Query, b: Query) -> Query:
    return _reduced({x | y for x in a for y in b})


def _of_strings(strings) -> Query:
    return _reduced({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _part(op, arg) -> tuple[set[str] | None, Query]:
    """Of one node: all lower-cased strings it can match, if few, and its query."""
    if op is kinds.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is kinds.IN:
        chars: set[str] = set()
        for what, value in arg:
            if what is kinds.LITERAL:
                chars.add(chr(value).lower())
            elif what is kinds.RANGE and value[1] - value[0] < 16:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 16 else (None, ANY)
    if op is kinds.SUBPATTERN:
        return _sequence(arg[-1])
    if op is kinds.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        exact = set().union(*[s for s, _ in parts if s is not None]) if all(s is not None for s, _ in parts) else None
        return exact, _reduced({grams for s, q in parts for grams in (_both(q, _of_strings(s)) if s is not None else q)})
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        least, most, inner = arg
        exact, query = _sequence(inner)
        if exact is not None and most == 1:
            return exact | ({""} if least == 0 else set()), ANY
        if exact is not None and least == most and len(exact) == 1:
            return {next(iter(exact)) * least}, ANY
        return None, ANY if least == 0 else query
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, ANY, True
    for op, arg in nodes:
        exact, needs = _part(op, arg)
        query = _both(query, needs)
        if exact is not None and len(exact) * len(strings) <= MOST:
            strings = {a + b for a in strings for b in exact}
        else:
            query = _both(query, _of_strings(strings))
            strings, whole = (exact if exact is not None else {""}), False
    return (strings, query) if whole else (None, _both(query, _of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-cased trigrams, one of which every match contains; ANY if there is no mandatory trigram."""
    strings, query = _sequence(parser.parse(pattern))
    return _both(query, _of_strings(strings)) if strings is not None else query


# --- index ------------------------------------------------------------------------------


def row_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """Inverted index of the given trigrams over ``body``: a row (gram, row_key) for each that a text holds."""
    low = rows.select("row_key", F.lower("body").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)])
    return low.select("row_key", F.explode(F.array_compact(held)).alias("gram"))


def candidates(index: DataFrame, grams: list[str], queries: dict[str, Query]) -> DataFrame:
    """Intersection of postings: ``row_key`` and a flag ``may_<kind>`` per rule, for keys that fulfil any rule's query."""
    words = -(-len(grams) // 62)
    bits = [F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.expr("shiftleft(1L, gram % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    held = index.groupBy("row_key").agg(*bits)

    def has(needed: frozenset) -> Column:
        masks = [0] * words
        for g in needed:
            at = grams.index(g)
            masks[at // 62] |= 1 << at % 62
        out = F.lit(True)
        for w, mask in enumerate(masks):
            if mask:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(mask)) == mask)
        return out

    flags = {}
    for kind, query in queries.items():
        flag = F.lit(False)
        for needed in sorted(query, key=sorted):
            flag = flag | has(needed)
        flags[f"may_{kind}"] = flag
    found = held.select("row_key", *[c.alias(n) for n, c in flags.items()])
    anything = F.lit(False)
    for name in flags:
        anything = anything | F.col(name)
    return found.where(anything)


# --- verification -----------------------------------------------------------------------

BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all earlier elements, for each element of a short array."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]


def add_spans(rows: DataFrame, rule: Rule, order: int, wanted: Column) -> DataFrame:
    """Adds ``s_<kind>``: structs (start, kind, end) of the rule's matches in ``body``, leftmost and non-overlapping.

    Places are code points: what stands between the matches (split) and the matches give lengths, whose running sums
    are taken in blocks of 256, so that many matches in one text cost little more than linear time.
    """
    found, size, parts, blocks, firsts, name = f"m_{rule.kind}", f"v_{rule.kind}", f"p_{rule.kind}", f"b_{rule.kind}", f"f_{rule.kind}", f"s_{rule.kind}"
    empty = F.array().cast("array<string>")
    rows = rows.withColumn(found, F.when(wanted, F.regexp_extract_all("body", F.lit(rule.pattern), F.lit(0))).otherwise(empty))
    rows = rows.withColumns({
        parts: F.when(F.size(found) > 0, F.split("body", rule.pattern, -1)).otherwise(empty),
        size: F.when(F.size(found) > 0, F.regexp_extract_all("body", F.lit(rule.pattern), F.lit(rule.value_group))).otherwise(empty),
    })
    steps = F.transform(found, lambda m, i: F.struct(
        F.char_length(F.get(parts, i)).cast("long").alias("gap"), F.char_length(m).cast("long").alias("long"), (F.char_length(F.get(size, i)) >= rule.least).alias("ok")))
    rows = rows.withColumn(blocks, F.when(F.size(found) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))).otherwise(
            F.array().cast("array<array<struct<gap:bigint,long:bigint,ok:boolean>>>")))
    whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["long"]))
    rows = rows.withColumn(firsts, _running(whole))

    def in_block(block: Column, index: Column) -> Column:
        before = _running(F.transform(block, lambda x: x["gap"] + x["long"]))
        first = F.get(firsts, index)
        return F.zip_with(block, before, lambda x, at: F.struct(
            (first + at + x["gap"]).alias("start"), F.lit(order).alias("kind"), (first + at + x["gap"] + x["long"]).alias("end"), x["ok"].alias("ok")))

    spans = F.filter(F.flatten(F.transform(blocks, in_block)), lambda s: s["ok"])
    return rows.withColumn(name, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).drop(found, size, parts, blocks, firsts)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """Every row with a last column ``secrets``: array of (start, kind, end) by start, then kind (its place in ``rules``).

    Starts and ends are code points, ends exclusive. Null and empty texts have none; repeated rows give a row each; other
    columns are carried along, whatever their names: where one is called like the new column, that gets underscores
    behind its ``name``. A table without rows gives none.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    grams = sorted({g for q in indexed.values() for needed in q for g in needed})
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), body.alias("body")).withColumn("row_key", F.xxhash64(F.col("row")[key], F.col("body")))
    if grams:
        may = candidates(postings(rows, grams), grams, indexed)
        rows = rows.join(may, "row_key", "left")
    for order, rule in enumerate(rules):
        wanted = F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False)) if rule.kind in indexed else F.lit(True)
        rows = add_spans(rows, rule, order, wanted)
    return rows.select("row.*", F.sort_array(F.concat(*[f"s_{r.kind}" for r in rules])).alias(free_name(name, docs.columns)))


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by a mark; null stays null."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        grown = F.when(s["start"] >= a["at"], F.array_append(F.array_append(a["out"], gap), F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), grown.alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(done)
