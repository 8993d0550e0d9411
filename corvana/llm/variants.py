"""Spelling variants: words one inserted, deleted or replaced code point apart, and the frequent form each belongs to.

Words of two lengths that differ by one error share their first half, or else their last half. So every word is put under its
first half (and the half as words one longer or shorter count it) and under its last half, and words under one half meet in a
task. There the words make a minimal acyclic automaton, forward over the words or backward over their mirror images, whose
edges carry how many words lie before them: the sum along a path is the word's number, which is its place in the list of
counts. Each word then follows its own half exactly from the start and completes the rest with one error. A near word that
both halves find is counted by the forward side alone, so no pair is ever a row: a task returns how many near words a word has
and the best of them. Halves of more than `GROUP` words are dealt into parts; whoever asks asks every part.

Forms lead to words ten times as frequent, so a chain has 18 steps at most in 64 bits; roots are found by doubling.

Defined results: null and empty texts have no words, long texts are taken whole. A null doc_id counts as the empty text before
the colon. Repeated rows count each time. Ties of counts go to the first word in code-point order. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lookup, saved, table, text_bytes

#: Code points and occurrences of a word, and how much more frequent its form is.
LENGTH, TIMES, RATIO = 7, 2, 10
#: Words counted in a task before they are handed on, words under one half that one task takes, and words of a task.
HELD, GROUP, SHARD = 400_000, 20_000, 60_000
RUN = re.compile("[A-Za-zÀ-ÿ]{7,}")  # a shorter run makes no word of LENGTH


def words(docs: DataFrame, one_in: int = 31) -> DataFrame:
    """(word, n) over all texts of docs(doc_id, text); in one of `one_in` runs of a text a code point is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(RUN.findall(text.lower().decode())).items():  # lower() of bytes knows A-Z alone
                    h = zlib.crc32(word.encode(), start)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LENGTH:
                            continue
                    held[word] += n
            if len(held) > HELD:
                yield out()
        yield out()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


class Automaton:
    """Minimal acyclic automaton of sorted words; an edge knows its target and how many words come before what it leads to."""

    def __init__(self, found: list[str]):
        self.final: list[bool] = []
        self.sizes: list[int] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        register: dict = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]  # open states of the word before, from the root
        last = ""
        for word in found:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            self._close(path, register, last, same)
            path += [({}, False) for _ in range(len(word) - same)]
            path[-1] = (path[-1][0], True)
            last = word
        self._close(path, register, last, 0)
        self.root = self._state(path[0], register)

    def _close(self, path: list, register: dict, word: str, depth: int) -> None:
        """States below depth are complete: each becomes one that reads the same, if there is one."""
        while len(path) > depth + 1:
            state = self._state(path.pop(), register)
            path[-1][0][word[len(path) - 1]] = state

    def _state(self, made: tuple[dict[str, int], bool], register: dict) -> int:
        children, final = made
        key = (final, *children.items())
        if (known := register.get(key)) is not None:
            return known
        before, edges = int(final), {}
        for c, target in children.items():
            edges[c] = (target, before)
            before += self.sizes[target]
        register[key] = len(self.edges)
        self.final.append(final)
        self.sizes.append(before)
        self.edges.append(edges)
        return len(self.edges) - 1

    def number(self, word: str, state: int | None = None, at: int = 0) -> int:
        """The word's number, or -1; from another state, of what is left of it."""
        state, edges = self.root if state is None else state, self.edges
        for c in word:
            step = edges[state].get(c)
            if step is None:
                return -1
            state, at = step[0], at + step[1]
        return at if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first `exact` code points of word and differ by one error after them."""
        state, at, edges, number = self.root, 0, self.edges, self.number
        for c in word[:exact]:
            step = edges[state].get(c)
            if step is None:
                return set()
            state, at = step[0], at + step[1]
        out = set()
        for k in range(exact, len(word) + 1):
            rest, after = word[k:], word[k + 1 :]
            if rest:
                out.add(number(after, state, at))
            own = word[k : k + 1]
            for c, (target, before) in edges[state].items():
                out.add(number(rest, target, at + before))  # c is inserted
                if rest and c != own:
                    out.add(number(after, target, at + before))
            step = edges[state].get(own) if own else None
            if step is None:
                break
            state, at = step[0], at + step[1]
        out.discard(-1)
        return out


def halves(found: DataFrame) -> DataFrame:
    """(back, k, half, word, n, asks): each word, mirrored for the backward side, under its own half and under the other half
    that words one shorter or longer have."""
    length = F.length("word")
    sides = []
    for back in (False, True):
        own = F.floor((length + F.lit(int(back))) / 2)
        other = F.floor((length + F.lit(int(back)) + F.when((length + F.lit(int(back))) % 2 == 0, -1).otherwise(1)) / 2)
        side = found.select(F.lit(back).alias("back"), (F.reverse("word") if back else F.col("word")).alias("word"), "n", own.alias("own"), F.explode(F.array(own, other)).alias("k"))
        sides.append(side.select("back", F.col("k").cast("int").alias("k"), "word", "n", (F.col("k") == F.col("own")).alias("asks")))
    return sides[0].union(sides[1]).withColumn("half", F.expr("left(word, k)"))


def meet(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) from the sorted words of each task; a word may come from both sides and several parts."""

    def answers(back: bool, k: int, held: list[tuple[str, int, bool]], out: dict[str, list]) -> None:
        listed = dict.fromkeys(w for w, n, _ in held if n)
        names, asking = list(listed), dict.fromkeys(w for w, _, asks in held if asks)
        counts = list({w: n for w, n, _ in held if n}.values())
        automaton = Automaton(names)
        for word in asking:
            numbers = automaton.near(word, k)
            if back:  # the forward side has those that share the first half too
                first = word[k:]
                numbers = [x for x in numbers if not names[x].endswith(first)]
            if numbers:
                n, best = min((-counts[x], names[x][::-1] if back else names[x]) for x in numbers)
                for column, value in zip(out.values(), (word[::-1] if back else word, len(numbers), -n, best), strict=True):
                    column.append(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        fresh = lambda: {"word": [], "n_near": [], "best_n": [], "best": []}
        for batch in batches:
            out = fresh()
            for back, k, word, n, asks in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if (back, k) != at:
                    if held:
                        answers(*at, held, out)
                    at, held = (back, k), []
                held.append((word, n, asks))
            yield pa.RecordBatch.from_pydict(out, schema)
        if held:
            answers(*at, held, out := fresh())
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    return rows.select("back", "k", "word", "n", "asks").mapInArrow(run, "word string, n_near long, best_n long, best string")


def near(found: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for each word of found(word, n) that has a near word."""
    rows, key = halves(found), ["back", "k", "half"]
    total = 4 * found.count()
    large = rows.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > GROUP)
    large = saved(large.select(F.struct(*key).alias("key"), F.ceil(F.col("c") / GROUP).cast("int").alias("parts"), F.col("c").alias("n")), "halves")
    dealt = rows.withColumn("part", F.lit(0))
    if large.limit(1).count():
        split = lookup(rows.withColumn("key", F.struct(*key)).withColumnRenamed("n", "times"), "key", large, total, "left").withColumnRenamed("times", "n")
        home = F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")), F.lit(0)).cast("int")
        there = split.select(*rows.columns, home.alias("home"), F.explode(F.when(F.col("asks") & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(home))).alias("part"))
        # In another part than its own a word only asks: it is not listed there.
        dealt = there.select(*(F.when(F.col("part") == F.col("home"), F.col("n")).alias("n") if c == "n" else F.col(c) for c in rows.columns), "part")
    tasks = max(1, -(-total // SHARD))
    sorted_rows = dealt.repartition(tasks, *key, "part").sortWithinPartitions("back", "k", "word")
    met = meet(sorted_rows)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    out = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): the word at the end of each chain. Each turn takes twice the steps."""
    at = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("more")), "roots")
    while at.where("more").limit(1).count():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        done, at = at, saved(at.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("more")), "roots")
        drop(done)
    return at.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of docs(doc_id, text)."""
    found = saved(words(docs), "words")
    close = found.join(near(found), "word", "left")
    better = F.col("best_n") >= RATIO * F.col("n")
    judged = saved(close.select("word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best_n")).alias("form_n")), "judged")
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
