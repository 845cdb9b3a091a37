"""Secret scans with a trigram inverted index, in DataFrame functions only.

A Boolean trigram query is derived from each rule's pattern. The index holds, for the trigrams that some query names,
the postings (trigram -> texts) found in one pass over each text; postings are intersected and united by key with one
bitwise aggregation, and only candidate texts meet the pattern. Rules without a mandatory trigram scan every text. A
Bloom filter of the candidates' keys keeps all other texts out of the shuffle, and a text with very many copies is
joined by broadcast.

Defined results: a null text is empty and has no spans; texts are keyed by a hash of the whole text, so repeated rows
and repeated or null ids are judged alike, and a hash collision can only add candidates, which the pattern then
rejects; an empty table gives no rows; other columns, whatever their names, are ignored or passed on; a very long text
is one row throughout. Matches are leftmost and do not overlap within a kind, equal starts go by the order of the kinds; a match with too short a value is dropped but still consumes its text.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, split_in


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java, RE2 and Python share; value: group whose length must reach min_value."""

    kind: str
    pattern: str
    value: int = 0
    min_value: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
ASSIGN = Rule("assign", f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12)
ACCESS = Rule("access", "AKIA[A-Z0-9]+", 0, 18)
HEX = Rule("hex", "[0-9a-f]{16,}", 0, 16)
BASE = (ASSIGN, ACCESS, HEX)
#: Kinds that the method adds; fixed public formats.
MORE = (
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# ---------------------------------------------------------------- trigram queries

#: A query is ANY, or an or (set) of ands (sets) of trigrams.
Query = frozenset | None
ANY: Query = None
_EXACT_MOST = 64


def _either(a: Query, b: Query) -> Query:
    if a is ANY or b is ANY:
        return ANY
    return frozenset(x for x in a | b if not any(y < x for y in a | b))


def _both(a: Query, b: Query) -> Query:
    if a is ANY or b is ANY:
        return b if a is ANY else a
    if len(a) * len(b) > _EXACT_MOST:
        return min(a, b, key=len)
    out: Query = frozenset()
    for x in a:
        out = _either(out, frozenset(x | y for y in b))
    return out


def _strings_query(strings: set[str]) -> Query:
    """Some string of the set occurs."""
    if any(len(s) < 3 for s in strings):
        return ANY
    out: Query = frozenset()
    for s in strings:
        out = _either(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out


def _node(op, arg):
    """(exact strings or None, query) of one node of a parsed pattern, in lower case."""
    if op is K.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is K.AT:
        return {""}, ANY
    if op is K.IN and all(k is K.LITERAL for k, _ in arg):
        return {chr(v).lower() for _, v in arg}, ANY
    if op is K.SUBPATTERN:
        return _info(arg[-1])
    if op is K.BRANCH:
        parts = [_info(x) for x in arg[1]]
        if all(e is not None for e, _ in parts):
            return set().union(*(e for e, _ in parts)), ANY
        query: Query = frozenset()
        for e, q in parts:
            query = _either(query, q if e is None else _strings_query(e))
        return None, query
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, body = arg
        e, q = _info(body)
        if e is not None and (low, high) == (0, 1):
            return e | {""}, ANY
        if e is not None and low == high and len(e) ** low <= _EXACT_MOST:
            own = {""}
            for _ in range(low):
                own = {a + b for a in own for b in e}
            return own, ANY
        if low:
            return None, q if e is None else _strings_query(e)
    return None, ANY


def _info(nodes) -> tuple[set[str] | None, Query]:
    """The same for consecutive nodes: exact strings are joined until a node breaks the run."""
    run, query, whole = {""}, ANY, True
    for op, arg in nodes:
        own, must = _node(op, arg)
        if own is not None and len(run) * len(own) <= _EXACT_MOST:
            run = {a + b for a in run for b in own}
            continue
        query = _both(_both(query, _strings_query(run)), must)
        run, whole = own or {""}, False
    return (run, ANY) if whole else (None, _both(query, _strings_query(run)))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern over lower-cased text; ANY if no trigram is mandatory."""
    exact, query = _info(list(parser.parse(pattern)))
    return query if exact is None else _strings_query(exact)


def trigrams_of(query: Query) -> frozenset[str]:
    return frozenset().union(*(query or ()))


def _holds(query: Query, bits: dict[str, int]) -> Column:
    """Whether the masks m0, m1, ... of 60 trigrams each satisfy the query."""
    out = F.lit(False)
    for term in query:
        one = F.lit(True)
        for k in sorted({bits[t] // 60 for t in term}):
            need = F.lit(sum(1 << bits[t] % 60 for t in term if bits[t] // 60 == k))
            one = one & (F.col(f"m{k}").bitwiseAND(need) == need)
        out = out | one
    return out


# ---------------------------------------------------------------- index and verification


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries name; a posting holds the place in this list."""
    return sorted(frozenset().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))


def any_of(words: list[str]) -> str:
    """A pattern that matches, without consuming it, each of some words of three characters: a trie in two levels."""
    tree: dict[str, dict[str, str]] = {}
    for w in words:
        tree.setdefault(w[0], {}).setdefault(w[1], "")
        tree[w[0]][w[1]] += w[2]
    safe = lambda c: c if c.isalnum() else f"\\x{ord(c):02x}"
    one = lambda tails: f"[{''.join(map(safe, tails))}]"
    branch = lambda c, below: safe(c) + "(?:" + "|".join(safe(d) + one(t) for d, t in sorted(below.items())) + ")"
    return f"(?={one(sorted(tree))})(?=(" + "|".join(branch(c, below) for c, below in sorted(tree.items())) + "))"


def build_postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Inverted index: postings(trigram, key, copies), trigram being a place in vocabulary(rules); copies is 1 in one
    posting of each row and 0 in the others."""
    words = vocabulary(rules)
    low = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    low = low.select(text_key(F.col("text")).alias("key"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_of(words)), F.lit(1))).alias("present"))
    place = F.create_map(*(F.lit(x) for i, w in enumerate(words) for x in (w, i)))
    rows = low.select("key", F.posexplode("present").alias("p", "word"))
    return rows.select("key", place[F.col("word")].alias("trigram"), (F.col("p") == 0).cast("long").alias("copies"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds, copies): texts that satisfy the trigram query of a rule, with the kinds to verify."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not ANY}
    bits = {t: i for i, t in enumerate(vocabulary(rules))}
    mask = lambda k: F.bit_or(F.expr(f"if(trigram div 60 = {k}, shiftleft(1L, trigram % 60), 0L)")).alias(f"m{k}")
    masks = build_postings(docs, rules).groupBy("key").agg(*map(mask, range(-(-len(bits) // 60))), F.sum("copies").alias("copies"))
    kinds = F.array_compact(F.array(*(F.when(_holds(q, bits), F.lit(k)) for k, q in queries.items())))
    return masks.select("key", kinds.alias("kinds"), "copies").where(F.size("kinds") > 0)


def match_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<s, o, e, kind>> of a rule's matches in code points, s from 0, e exclusive, o the rule's place."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(found, F.length).alias("m"), F.transform(values, F.length).alias("v"))
    none = F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>")
    span = lambda at, x: F.struct((at + x["g"]).alias("s"), F.lit(order).alias("o"), (at + x["g"] + x["m"]).alias("e"), F.lit(rule.kind).alias("kind"))
    walk = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.coalesce(x["m"], F.lit(0))).alias("at"),
            F.when(x["v"] >= rule.min_value, F.concat(acc["out"], F.array(span(acc["at"], x)))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return walk["out"]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with found: array<struct<s, o, e, kind>> of all kinds by start, then rule order; other columns are kept,
    but a column of docs that is named found gives way."""
    picked = materialize(candidates(docs, rules), "secret-candidates")
    picked = picked.select(F.col("key").alias("_loom_key"), F.col("kinds").alias("_loom_kinds"), F.col("copies").alias("_loom_copies"))
    kept = [c for c in docs.columns if c != "found"]
    keyed = docs.select(*(F.col(f"`{c}`") for c in kept), text_key(F.coalesce("text", F.lit(""))).alias("_loom_key"))
    some, other = split_in(keyed, "_loom_key", picked)
    some = join_hot(some, picked, "_loom_key", "_loom_copies", docs.count(), how="left").drop("_loom_copies")
    keyed = some.unionByName(other.withColumn("_loom_kinds", F.lit(None).cast("array<string>")))
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>")
    parts = []
    for order, r in enumerate(rules):
        full = trigram_query(r.pattern) is ANY
        wanted = text.rlike(r.pattern) if full else F.coalesce(F.array_contains("_loom_kinds", r.kind), F.lit(False))
        parts.append(F.when(wanted, match_spans(text, r, order)).otherwise(none))
    found = F.array_sort(F.concat(*parts))
    return keyed.select(*(F.col(f"`{c}`") for c in kept), found.alias("found"))


def spans_text(found: Column) -> Column:
    one = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of text replaced by [kind]; overlapping spans are cut once. Null texts stay null.

    A column n_chars follows the new text where something was cut."""
    other = docs.withColumnRenamed("found", "_loom_found") if "found" in docs.columns else docs
    text = F.col("text")
    cut = F.aggregate(
        F.col("found"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(
            x["e"] > acc["at"],
            F.struct(
                x["e"].alias("at"),
                F.when(
                    x["s"] >= acc["at"],
                    F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), x["kind"], F.lit("]")),
                ).otherwise(acc["out"]).alias("out"),
            ),
        ).otherwise(acc),
    )
    joined = F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length("text")))
    out = find_secrets(other, rules).withColumn("_loom_text", F.when(F.size("found") == 0, text).otherwise(joined))
    new = {"text": F.col("_loom_text"), "found": F.col("_loom_found") if "found" in docs.columns else None}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("found") > 0, F.length("_loom_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns))
