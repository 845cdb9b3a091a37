"""Dictionary matching: term lists of any length found in one pass over a text by an Aho-Corasick automaton.

The automaton is built once in each Python worker and kept; the plan has one Arrow function whatever the lists hold. A term
stands in a text as a whole word or phrase (no ASCII letter or digit beside it) or anywhere. Lists that come from a table are
taken in blocks of bounded bytes, one pass each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of terms that one automaton holds, and automata that a worker keeps; texts of a batch that are Python strings at a time.
BLOCK_BYTES, KEPT, TEXTS = 32 << 20, 8, 256
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Machine:
    """Finds for each named list the numbers of its terms that a lower-cased text has."""

    def __init__(self, lists: list[list[str]], whole: bool):
        import ahocorasick

        self.n, self.whole, self.automaton = len(lists), whole, ahocorasick.Automaton()
        homes: dict[str, list[tuple[int, int]]] = {}
        for k, terms in enumerate(lists):
            for i, t in enumerate(terms):
                if t:
                    homes.setdefault(t.lower(), []).append((k, i))
        for t, own in homes.items():
            self.automaton.add_word(t, (len(t), own))
        if homes:
            self.automaton.make_automaton()
        self.empty = not homes

    def find(self, text: str | None) -> list[list[int]]:
        found: list[set[int]] = [set() for _ in range(self.n)]
        if text and not self.empty:
            seen, last = set(), len(text)
            for end, (size, own) in self.automaton.iter(text):
                if id(own) in seen or self.whole and (
                    (end >= size and text[end - size] in _WORD) or (end + 1 < last and text[end + 1] in _WORD)
                ):
                    continue
                seen.add(id(own))
                for k, i in own:
                    found[k].add(i)
        return [sorted(f) for f in found]


_machines: dict[str, Machine] = {}


def machine_of(lists: list[list[str]], whole: bool) -> Machine:
    key = hashlib.sha256(repr((whole, lists)).encode()).hexdigest()
    if key not in _machines:
        while len(_machines) >= KEPT:
            _machines.pop(next(iter(_machines)))
        _machines[key] = Machine(lists, whole)
    return _machines[key]


def found_in_lists(text: Column, lists: dict[str, list[str]], whole: bool = True, labels: bool = False, once: bool = False) -> Column:
    """struct of an array for each list: its terms that the text has, in list order; an array of at most one, the list's
    name, if labels. A null text has none. once: the plan may filter on the result without a second pass."""
    ship(SparkSession.active())
    names, terms = list(lists), [list(v) for v in lists.values()]

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = machine_of(terms, whole)
        for batch in texts:
            yield pa.concat_arrays([look_up(m, batch.slice(i, TEXTS)) for i in range(0, max(len(batch), 1), TEXTS)])

    def look_up(m: Machine, some: pa.Array) -> pa.Array:
        found = [m.find(t.as_py()) for t in some]
        out = [pa.array([([n] if f[k] else []) if labels else [terms[k][i] for i in f[k]] for f in found], pa.list_(pa.string())) for k, n in enumerate(names)]
        return pa.StructArray.from_arrays(out, names=[f"l{k}" for k in range(len(names))])

    kind = "struct<" + ",".join(f"l{k}:array<string>" for k in range(len(names))) + ">"
    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, kind)
    found = (udf.asNondeterministic() if once else udf)(F.lower(text))
    return F.transform(F.array(found), lambda s: F.struct(*(s[f"l{k}"].alias(n) for k, n in enumerate(names))))[0]


def found_in(text: Column, terms: list[str], whole: bool = True, once: bool = False) -> Column:
    """The terms that the text has, in list order."""
    return found_in_lists(text, {"terms": terms}, whole, once=once)["terms"]


def labels_in(text: Column, lists: dict[str, list[str]], whole: bool = True) -> Column:
    """The names of the lists of which the text has a term, in order."""
    names = list(lists)
    found = found_in_lists(text, lists, whole, labels=True)
    return F.transform(F.array(found), lambda s: F.concat(*(s[n] for n in names)))[0]


def term_blocks(table: DataFrame, term: str, limit: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The distinct terms of a table in blocks of about limit bytes, sorted; the driver holds one block at a time."""
    rows = table.select(F.col(term).alias("term")).where("term <> ''").distinct()
    size = rows.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        yield sorted(r.term for r in rows.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).collect())


def find_table_terms(df: DataFrame, text: str, table: DataFrame, term: str, out: str = "terms", whole: bool = True, limit: int = BLOCK_BYTES) -> DataFrame:
    """df with the sorted terms of a table that its text has."""
    blocks = [found_in(F.col(text), b, whole) for b in term_blocks(table, term, limit)]
    return df.withColumn(out, blocks[0] if len(blocks) == 1 else F.array_sort(F.concat(*blocks)))
