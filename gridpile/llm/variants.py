"""Spelling variants: words one edit apart, by a forward and a backward minimal acyclic automaton with perfect-hash word numbers.

One edit leaves one half of a word as it is: if the shorter of two near words has l letters and h = l div 2, either the first h
letters of both are the same or the last l - h. So every word is filed under two keys, (l, first half) and (l, second half), and
asks under the keys of its own length and of one letter less. Keys are dealt out over shards. A shard builds two automata over
its words, one from the front and one, for the second halves, over the words turned round; each follows the half that must agree
letter by letter and completes the rest with one error. The automata number their words in order, so matches are numbers, told
apart by a set, and a pair that the forward automaton finds too is left to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One occurrence in so many loses a letter.
DAMAGE = 97
#: A word's form occurs at least so many times as often.
FORM = 2
#: Words filed in a shard, and under one key before the key is split.
SHARD_WORDS = 4_000
KEY_WORDS = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """A minimal acyclic automaton over words given in ascending order. A state maps a letter to (state, words that come before
    those behind that letter); final states accept. The number of a word is the sum of those counts along its path."""

    def __init__(self, words: Iterable[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.behind: list[int] = []
        self.register: dict[tuple, int] = {}
        # states of the last word that are still open: (final, {letter: state})
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            self._close(path, last, same)
            path += [([False], {}) for _ in w[same:]]
            path[-1][0][0] = True
            last = w
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, keep: int) -> None:
        for i in range(len(word), keep, -1):
            path[i - 1][1][word[i - 1]] = self._state(*path.pop())

    def _state(self, final: list[bool], children: dict[str, int]) -> int:
        key = (final[0], *children.items())
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.edges)
            count, edges = int(final[0]), {}
            for letter, child in children.items():  # in ascending order, as the words are
                edges[letter] = (child, count)
                count += self.behind[child]
            self.edges.append(edges)
            self.final.append(final[0])
            self.behind.append(count)
        return state

    def follow(self, state: int, number: int, letters: str) -> tuple[int, int] | None:
        edges = self.edges
        for c in letters:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def near(self, half: str, rest: str, shorter: bool) -> set[int]:
        """Numbers of the words that start with half and go on as rest with one letter replaced or, if shorter, one left out."""
        found: set[int] = set()
        at = self.follow(self.start, 0, half)
        if at is None:
            return found
        state, number = at
        for i, c in enumerate(rest):
            if shorter:
                end = self.follow(state, number, rest[i + 1 :])
                if end and self.final[end[0]]:
                    found.add(end[1])
            else:
                for other, (child, before) in self.edges[state].items():
                    if other != c:
                        end = self.follow(child, number + before, rest[i + 1 :])
                        if end and self.final[end[0]]:
                            found.add(end[1])
            step = self.edges[state].get(c)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def _matches(filed: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n) of one shard: filed (own, own_n, back), asked (query, query_n, l, turned)."""
    if filed.empty or asked.empty:  # of a shard without rows on one side pandas gets no columns
        return
    for back in (False, True):
        own = filed[filed["back"] == back]
        turned = {(w[::-1] if back else w): (w, n) for w, n in zip(own["own"], own["own_n"], strict=True)}
        order = sorted(turned)
        automaton = Automaton(order)
        rows = asked[asked["turned"] == back].drop_duplicates(["query", "l"])  # parts of one key may lie in one shard
        for w, n, length in zip(rows["query"], rows["query_n"], rows["l"], strict=True):
            h = length // 2
            same = length - h if back else h
            t = w[::-1] if back else w
            for number in automaton.near(t[:same], t[same:], len(w) > length):
                other, m = turned[order[number]]
                if back and w[:h] == other[:h]:
                    continue  # the forward automaton finds this pair
                yield w, n, other, m
                if len(other) < len(w):
                    yield other, m, w, n  # longer words are asked for by themselves alone


def words(documents: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of documents (doc_id, text): runs of letters, only A-Z lower-cased, one in damage without one of its letters."""
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run"))
    return h.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_words(table: DataFrame, shard_words: int = SHARD_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """All pairs of words (word, n) one edit apart, both ways round: word, n, other, other_n. table is read several times."""
    length = F.length("word")
    key = lambda l, back: F.struct(
        l.cast("int").alias("l"), F.lit(back).alias("back"),
        (F.substring(F.col("word"), length - (l - F.floor(l / 2)).cast("int") + 1, length) if back else F.substring(F.col("word"), F.lit(1), F.floor(l / 2).cast("int"))).alias("half"))
    filed = table.select("word", "n", F.explode(F.array(key(length, False), key(length, True))).alias("k"))
    asked = table.select("word", "n", F.explode(F.array(*[key(length - d, b) for d in (0, 1) for b in (False, True)])).alias("k")).where(F.col("k.l") >= LEAST_LETTERS)
    # a key of very many words is filed in parts, and who asks for it asks each part
    large = stored(filed.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > key_words).select("k", F.ceil(F.col("c") / key_words).cast("int").alias("parts")), "large-keys")
    if large.isEmpty():
        filed, asked = (x.withColumn("part", F.lit(0)) for x in (filed, asked))
    else:
        large = broadcast_if_small(large)
        filed = filed.join(large, "k", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        asked = asked.join(large, "k", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    shards = max(1, -(-2 * table.count() // shard_words))
    shard = F.pmod(F.xxhash64("k", "part"), F.lit(shards)).alias("shard")
    # both sides are made of one table: columns of their own keep Spark from pruning one side's for the other's
    filed = filed.select(shard, F.col("word").alias("own"), F.col("n").alias("own_n"), F.col("k.back").alias("back"))
    asked = asked.select(shard, F.col("word").alias("query"), F.col("n").alias("query_n"), F.col("k.l").alias("l"), F.col("k.back").alias("turned"))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_matches(left, right)), columns=["word", "n", "other", "other_n"])

    return filed.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(match, "word string, n bigint, other string, other_n bigint")


def variants(documents: DataFrame) -> DataFrame:
    """Words of the documents with their variants: word, n, n_near, form, form_n, root.

    A word has at least LEAST_LETTERS letters and LEAST_COUNT occurrences; near words differ by one letter put in, left out or
    replaced. form is the near word of largest n, of those the first in code-point order, if it occurs at least FORM times as
    often; root is where the forms lead in the end. Counts at least double with each form, so the way to the root has no more
    steps than the largest count has bits, and is followed by doubling. Whole texts of any length are read; null and empty texts
    have no words, a null doc_id enters the damage as an empty one, repeated rows count each, other columns are ignored and an
    empty table has no words.
    """
    table = stored(words(documents), "words")
    best = F.min(F.struct(-F.col("other_n"), F.col("other")).alias("b"))
    near = near_words(table).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    found = table.join(near, "word", "left")
    form_n = -F.col("b.col1")
    good = F.col("b").isNotNull() & (form_n >= FORM * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("b.other")).alias("form"), F.when(good, form_n).alias("form_n"))
    found = stored(found, "forms")
    ways = found.where("form is not null").select("word", F.col("form").alias("root"))
    ways = stored(ways, "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return found.join(ways, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
