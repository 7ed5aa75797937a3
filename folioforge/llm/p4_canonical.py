"""Problem 4: mapping free-entered values to a reference list.

Method: a trie of the reference entries, alias paths included, searched with a Levenshtein automaton (with
transpositions).  The automaton of a value is a row of bits per number of edits; along each edge of the trie all
values of a batch step together, and a (value, node) is left once no state of it is alive.  All entries within a
length-dependent distance come out (``matches``); in ``resolve`` the nearest wins, then the one with more exact uses, then
the smaller id.

Alias paths of an entry: the words joined without blanks, the words in reverse order, the last word in the
plural, and (exact only) each word cut to a prefix of three letters or more.  Values are folded first: compatibility
forms, accents, case, label prefixes such as ``genre:``, hash signs, camel case, quotes, punctuation, articles.  Last words that
say nothing are learned from the values: a word that follows LEARNED_FROM different entries or more, written out, is left out
where the value with it is no entry.

Scale: values collapse to distinct ones before matching and join back by value, so a hot value is matched once.  Matching
runs in a fixed number of tasks.  A reference list of at most REFERENCE_ROWS rows goes to every task; a longer one is cut
into blocks of about that size, and each block meets the values in one cogrouped shuffle, without the driver.

Defined results: null and blank values are left out; a value equal to a reference entry is not reported by
``resolve`` with ``skip_exact``; a value that matches nothing gets -1; rows repeated under other ids each get a row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut

REFERENCE_ROWS = 20_000
#: Longest entry, in folded characters, for a distance of 0, 1 and 2; beyond that 3.
BUDGET_STEPS = (3, 7, 29)
SHORTEST_PREFIX, LEARNED_FROM = 3, 3
_LABEL = re.compile(r"^(?:[\w ]{1,20}:\s*)+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+")


def budget(length: int) -> int:
    return sum(length > step for step in BUDGET_STEPS)


def fold(text: str) -> str:
    """Folded words of a value, single blanks between them; a trailing dot of a cut word stays as ``.``."""
    t = unicodedata.normalize("NFKD", text).strip()
    t = "".join(c for c in t if not unicodedata.combining(c))
    if "#" in t:
        t = _CAMEL.sub(" ", t)
    t = _LABEL.sub("", t.lower()).strip()
    if "," in t and t.count(",") == 1:  # "house, haunted"
        a, b = t.split(",")
        if a.strip() and b.strip():
            t = f"{b.strip()} {a.strip()}"
    cut = re.sub(r"([^\W_]{3,})\.(?=\s+\w)", r"\1%", t)
    words = re.findall(r"[^\W_]+%?", cut)
    if len(words) > 1 and words[0] in ("the", "a", "an"):
        words = words[1:]
    return " ".join(words)


def plural(word: str) -> str:
    if word.endswith(("s", "x", "ch", "sh")):
        return word + "es"
    if word.endswith("y") and word[-2:-1] not in "aeiou":
        return word[:-1] + "ies"
    if word.endswith("fe"):
        return word[:-2] + "ves"
    return word + "s"


def aliases(entry: str) -> Iterator[tuple[str, bool]]:
    """(path, whether edits are allowed on it)."""
    words = entry.split(" ")
    yield entry, True
    if len(words) > 1:
        yield "".join(words), True
        yield " ".join(reversed(words)), True
    yield " ".join([*words[:-1], plural(words[-1])]), True
    for i, w in enumerate(words):
        for k in range(SHORTEST_PREFIX, len(w)):
            yield " ".join([*words[:i], w[:k] + "%", *words[i + 1 :]]), False


#: Values searched together, the longest value that fits the bits of a machine word, and values per cogroup.
TOGETHER, WORD_BITS, GROUP_VALUES = 256, 62, 50_000


class Trie:
    """All paths of the reference entries; nodes are numbered, edges lie in arrays by node."""

    def __init__(self, entries: list[tuple[int, str]], weight: dict[int, int] | None = None, paths: Callable = aliases):
        self.weight = weight or {}
        self.ends: dict[str, list[tuple[int, bool]]] = {}
        for key, name in entries:
            folded = fold(name or "")
            if folded:
                for path, edits in paths(folded):
                    self.ends.setdefault(path, []).append((key, edits))
        edges: list[tuple[int, str, int]] = []
        node_of = {"": 0}
        self.at: dict[int, list[int]] = {}
        for path in self.ends:
            keys = [key for key, edits in self.ends[path] if edits]
            if keys:  # paths that allow no edits are looked up whole
                for k in range(1, len(path) + 1):
                    if path[:k] not in node_of:
                        node_of[path[:k]] = len(node_of)
                        edges.append((node_of[path[: k - 1]], path[k - 1], node_of[path[:k]]))
                self.at[node_of[path]] = keys
        self.depth = max(map(len, node_of))
        self.letters = {c: i for i, c in enumerate(sorted({c for _, c, _ in edges}))}
        edges.sort()
        self.letter = np.array([self.letters[c] for _, c, _ in edges], np.int64)
        self.child = np.array([n for _, _, n in edges], np.int64)
        self.many = np.bincount(np.array([p for p, _, _ in edges], np.int64), minlength=len(node_of))
        self.first = np.cumsum(self.many) - self.many
        self.final = np.zeros(len(node_of), bool)
        self.final[list(self.at)] = True

    def exact(self, folded: str) -> list[tuple[int, int]]:
        return [(0, key) for key, _ in self.ends.get(folded, ())]

    def within(self, values: list[str], most: int) -> list[list[tuple[int, int]]]:
        """Per folded value, (distance, key) of every entry within ``most`` edits."""
        found: list[dict[int, int]] = [{} for _ in values]
        near = [i for i, v in enumerate(values) if len(v) <= self.depth + most]
        near.sort(key=lambda i: len(values[i]))
        for a in range(0, len(near), TOGETHER):
            self._search([values[i] for i in near[a : a + TOGETHER]], most, [found[i] for i in near[a : a + TOGETHER]])
        return [[(d, key) for key, d in f.items()] for f in found]

    def _search(self, values: list[str], most: int, found: list[dict[int, int]]) -> None:
        kind = np.uint64 if max(map(len, values)) <= WORD_BITS else object
        one = np.uint64(1) if kind is np.uint64 else 1
        two = one + one
        # bit i of masks[v, c]: the i-th letter of the value is c; bit i of state j: i letters are read with at most j edits
        masks = np.zeros((len(values), len(self.letters) + 1), kind)
        for i, v in enumerate(values):
            for k, c in enumerate(v):
                if c in self.letters:
                    masks[i, self.letters[c]] |= one << kind(k) if kind is np.uint64 else 1 << k
        goal = np.array([1 << len(v) for v in values], kind)
        who, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        states = [np.array([(2 << j) - 1] * len(values), kind) for j in range(most + 1)]
        before = [np.zeros(len(values), kind) for _ in range(most)]
        last = np.zeros(len(values), kind)
        while len(who):
            many = self.many[node]
            up = np.repeat(np.arange(len(who)), many)
            edge = self.first[node][up] + np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
            who, node = who[up], self.child[edge]
            mask, last = masks[who, self.letter[edge]], last[up]
            old, older = [s[up] for s in states], [s[up] for s in before]
            states = [(old[0] & mask) << one]
            for j in range(1, most + 1):
                step = ((old[j] & mask) << one) | old[j - 1] | ((old[j - 1] | states[j - 1]) << one)
                states.append(step | ((older[j - 1] & (last >> one) & mask) << two))
            live = states[most] != 0
            hit = np.flatnonzero(live & self.final[node])
            for j in range(most, -1, -1):
                for x in hit[(states[j][hit] & goal[who[hit]]) != 0].tolist():
                    for key in self.at[int(node[x])]:
                        own = found[who[x]]
                        own[key] = min(own.get(key, most + 1), j)
            who, node, last = who[live], node[live], mask[live]
            before = [s[live] for s in old[:most]]
            states = [s[live] for s in states]

    def shortened(self, folded: str, idle: frozenset) -> str:
        """A value without its last word, if that says nothing and the whole is no entry."""
        rest, _, word = folded.rpartition(" ")
        return rest if rest and word in idle and folded not in self.ends else folded

    def trailing(self, text: str) -> tuple[str, int] | None:
        """(last word, entry) of a value that is an entry and one word more."""
        folded = fold(text)
        rest, _, word = folded.rpartition(" ")
        hits = () if folded in self.ends else self.ends.get(rest, ())
        return (word, min(key for key, _ in hits)) if hits else None

    def matches(self, texts: list[str], idle: frozenset, nearest: bool = False) -> list[list[tuple[int, int]]]:
        """Per value, (distance, key) of every entry within its budget; with ``nearest`` no search where a path is met
        exactly."""
        folded = [self.shortened(fold(t), idle) for t in texts]
        out = [self.exact(f) for f in folded]
        by_budget: dict[int, list[int]] = {}
        for i, f in enumerate(folded):
            if f and budget(len(f)) and "%" not in f and not (nearest and out[i]):
                by_budget.setdefault(budget(len(f)), []).append(i)
        for most, rows in by_budget.items():
            for i, hits in zip(rows, self.within([folded[i] for i in rows], most), strict=True):
                best = dict((key, d) for d, key in hits) | dict((key, 0) for _, key in out[i])
                out[i] = [(d, key) for key, d in best.items()]
        return out

    def best(self, texts: list[str], idle: frozenset = frozenset()) -> list[tuple[int, int, int] | None]:
        """(distance, -uses, key) of the entry that each value stands for."""
        return [min(((d, -self.weight.get(key, 0), key) for d, key in hits), default=None) for hits in self.matches(texts, idle, nearest=True)]


_BEST, _ALL, _LAST = "v string, d bigint, u bigint, k bigint", "v string, k bigint, d bigint", "w string, k bigint"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if kind == "string" else pa.int64()) for i, (_, kind) in enumerate(columns)], names=[n for n, _ in columns])


def _best_of(idle: frozenset) -> Callable:
    return lambda trie, values: _rows([(v, *(b or (None,) * 3)) for v, b in zip(values, trie.best(values, idle), strict=True)], _BEST)


def _all_of(idle: frozenset) -> Callable:
    return lambda trie, values: _rows([(v, key, d) for v, hits in zip(values, trie.matches(values, idle), strict=True) for d, key in hits], _ALL)


def _trailing_of(trie: Trie, values: list[str]) -> pa.RecordBatch:
    return _rows([found for v in values if (found := trie.trailing(v))], _LAST)


def idle_words(distinct: DataFrame, weighted: DataFrame) -> frozenset:
    """Last words that say nothing; they are far fewer than the entries that each of them follows."""
    seen = _searched(distinct, weighted, _trailing_of, _LAST).groupBy("w").agg(F.count_distinct("k").alias("n"))
    return frozenset(r.w for r in seen.where(F.col("n") >= LEARNED_FROM).select("w").collect())


def _searched(distinct: DataFrame, weighted: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """``answer`` for all values ``distinct``(v, uses) against all entries ``weighted``(k, name, uses)."""
    session = distinct.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    size = weighted.count()
    if size <= REFERENCE_ROWS:
        entries = [(x.k, x.name, x.uses) for x in weighted.collect()]

        def run(batches: Iterator[pa.RecordBatch]):
            trie = Trie([x[:2] for x in entries], {x[0]: x[2] for x in entries})
            for batch in batches:
                yield answer(trie, batch.column(0).to_pylist())

        # Spark would drop a repartition by ``v``, by which the values are placed already, and put the small shuffle into one
        # task; matching costs CPU, not bytes, so values are placed anew by their hash.
        return distinct.select("v").repartition(tasks, F.xxhash64("v")).mapInArrow(run, schema)
    blocks = -(-size // REFERENCE_ROWS)
    parts = max(1, -(-distinct.count() // GROUP_VALUES))
    left = distinct.select("v", F.pmod(F.xxhash64("v"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = weighted.select("k", "name", "uses", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))

    def meet(values: pa.Table, entries: pa.Table) -> pa.Table:
        rows = entries.to_pylist()
        trie = Trie([(x["k"], x["name"]) for x in rows], {x["k"]: x["uses"] for x in rows})
        return pa.Table.from_batches([answer(trie, batch.column("v").to_pylist()) for batch in values.to_batches()])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, schema)


def _tables(values: DataFrame, reference: DataFrame, id_col: str, text_col: str, key_col: str, name_col: str) -> tuple[DataFrame, ...]:
    rows = values.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("v")).where(r"v is not null and v rlike '[^\\s\\u00A0]'")
    names = reference.select(F.col(key_col).cast("bigint").alias("k"), F.col(name_col).alias("name")).where("name is not null").groupBy("name").agg(F.min("k").alias("k"))
    distinct = cut(rows.groupBy("v").agg(F.count("*").alias("uses")))  # read several times below
    exact = distinct.join(names, F.col("v") == F.col("name")).select("v", "k", "uses")
    weighted = names.join(exact.select("k", "uses"), "k", "left").select("k", "name", F.coalesce("uses", F.lit(0)).alias("uses"))
    return rows, names, distinct, exact, weighted


def resolve(values: DataFrame, reference: DataFrame, id_col: str = "id", text_col: str = "tag_text", key_col: str = "id", name_col: str = "name", skip_exact: bool = True) -> DataFrame:
    """(id, tag_id) of every row with a value that isn't blank; -1 where no entry is near enough."""
    rows, names, distinct, exact, weighted = _tables(values, reference, id_col, text_col, key_col, name_col)
    rest = distinct.join(names, F.col("v") == F.col("name"), "left_anti")
    found = _searched(rest, weighted, _best_of(idle_words(rest, weighted)), _BEST)
    found = found.groupBy("v").agg(F.min(F.when(F.col("k").isNotNull(), F.struct("d", "u", "k"))).alias("m"))
    resolved = found.select("v", F.coalesce("m.k", F.lit(-1)).cast("bigint").alias("tag_id"))
    if not skip_exact:
        resolved = resolved.unionByName(exact.select("v", F.col("k").alias("tag_id")))
    return rows.join(resolved, "v").select("id", "tag_id")


def matches(values: DataFrame, reference: DataFrame, id_col: str = "id", text_col: str = "tag_text", key_col: str = "id", name_col: str = "name") -> DataFrame:
    """(tag_text, tag_id, distance): of every different value all entries within the distance that its length allows."""
    _, _, distinct, _, weighted = _tables(values, reference, id_col, text_col, key_col, name_col)
    found = _searched(distinct, weighted, _all_of(idle_words(distinct, weighted)), _ALL)
    return found.groupBy("v", "k").agg(F.min("d").alias("distance")).select(F.col("v").alias("tag_text"), F.col("k").alias("tag_id"), "distance")
