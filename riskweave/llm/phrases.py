"""Word collocations, counted in depth-truncated suffix trees that are built group by group.

The suffixes of all pieces of text, cut after MAX_WORDS words, form a tree whose node for a phrase has as many leaves
below it as the phrase has occurrences. The tree of a large corpus fits no memory, so it is partitioned vertically: its
prefixes of two words are counted first, those that are too rare are cut off, and a prefix with more
suffixes than a task should hold is extended by one word, again and again. Prefixes are then dealt to groups
by their hash, as many groups as keep each within the budget, and every group builds its subtrees from
its own suffixes alone: sorted, a node is a run of them, and its count the total of their leaves.

Texts are read for the words, for the prefixes (once more for each extension) and for the suffixes. Equal suffixes of a
task are one with a count before anything is shuffled, and travel as one row per task and group. Words are told apart by 64-bit hashes of language and word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shuffle_width
from .common import SLICE_BYTES, bound_batches, column, discard, mix, pair_hash, settle, signed, slices, text_buffer

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Suffixes that a group may hold; a prefix with more is extended.
BUDGET = 1 << 18
#: Parts of a language that are ranked on their own first.
PARTS = 64
#: Distinct suffixes, prefixes or words that a task counts before it hands them on.
HELD = 1 << 20
#: Largest filter of frequent words or prefixes, in bits. A full filter lets more through; counts stay exact.
FILTER_BITS = 1 << 27
NO_LANGUAGE = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


# ---- words of a task --------------------------------------------------------------------


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the word hash and of its inverse, modulo 2^64."""
    base, out = 0x9E3779B97F4A7C15, []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, out=p))
    return out[0], out[1]


def _words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte and hash of the words of one buffer, and the number of breaks before each.

    ``buf`` is in lower case. No word crosses a place in ``starts``.
    """
    word = ~_GAP[buf]
    cuts = starts[(starts > 0) & (starts < len(buf))]
    opens, ends = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    opens[cuts] = word[cuts]
    ends[cuts - 1] = word[cuts - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(ends)
    power, inverse = _powers(1 << max(12, len(buf).bit_length()))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    hashes = mix((total[last + 1] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return first, last, hashes, np.cumsum(_BREAK[buf])[first]


def _long_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of one long text, worked on in stretches that end at a gap."""
    parts, at, breaks = [], 0, 0
    while at < len(buf):
        to = min(len(buf), at + SLICE_BYTES)
        while to < len(buf) and not _GAP[buf[to]]:
            gap = np.flatnonzero(_GAP[buf[to : to + SLICE_BYTES]])
            to = to + int(gap[0]) if len(gap) else min(len(buf), to + SLICE_BYTES)
        first, last, hashes, before = _words(buf[at:to], np.zeros(1, np.int64))
        parts.append((first + at, last + at, hashes, before + breaks))
        breaks += int(_BREAK[buf[at:to]].sum())
        at = to
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Scanned:
    """The words of a slice of texts: ``keys`` of language and word, and whether each is followed by another.

    ``next[i]`` says that word i + 1 follows word i in one piece of one text.
    """

    def __init__(self, raw: np.ndarray, places: np.ndarray, languages: list[str]):
        lo = int(places[0])
        self.buf = _LOWER[raw[lo : int(places[-1])]]
        starts = places[:-1] - lo
        if len(starts) == 1 and len(self.buf) > 2 * SLICE_BYTES:
            self.first, self.last, hashes, breaks = _long_words(self.buf)
        else:
            self.first, self.last, hashes, breaks = _words(self.buf, starts)
        # an empty text begins where the next one does: the last of them has the word
        self.text = np.searchsorted(starts, self.first, "right") - 1
        codes = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in set(languages)}
        self.keys = pair_hash(np.array([codes[x] for x in languages], np.uint64)[self.text], hashes)
        self.keys[self.keys == 0] = 1  # 0 stands for no word
        piece = breaks + self.text
        self.next = np.zeros(len(self.keys), bool)
        if len(piece):
            self.next[:-1] = piece[1:] == piece[:-1]

    def word(self, i: int) -> str:
        return self.buf[self.first[i] : self.last[i] + 1].tobytes().decode("utf-8", "replace")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Scanned, list[str]]]:
    for batch in batches:
        raw, places = text_buffer(column(batch, "text"))
        languages = column(batch, "lang").to_pylist()
        for i, j in slices(places, SLICE_BYTES):
            if places[j] > places[i]:
                yield Scanned(raw, places[i : j + 1], languages[i:j]), languages[i:j]


class Tally:
    """Counts of distinct rows of a task."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray, rows: np.ndarray, counts: np.ndarray | None = None) -> None:
        """``rows`` that are equal have equal ``keys``."""
        if len(keys):
            self.parts.append(self._distinct(keys, rows, np.ones(len(keys), np.int64) if counts is None else counts))
            self.held += len(self.parts[-1][0])

    @staticmethod
    def _distinct(keys, rows, counts):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], rows[order[at]], np.add.reduceat(counts, at)

    def full(self) -> bool:
        if self.held > HELD and len(self.parts) > 1:
            parts, self.parts, self.held = self.parts, [], 0
            self.add(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        return self.held > HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and counts; the tally is empty afterwards."""
        parts, self.parts, self.held = self.parts, [], 0
        self.add(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        _, rows, counts = self.parts[0]
        self.parts, self.held = [], 0
        return rows, counts


# ---- readings of the texts ----------------------------------------------------


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """``key, lang, word, n`` of the words that occur at least so often, and per language a row without word, of all."""

    def run(batches):
        keys, counts, names = np.empty(0, np.uint64), np.empty(0, np.int64), []
        totals: dict[str, int] = {}

        def rows():
            columns = [signed(keys), *(pa.array([x[i] for x in names], pa.string()) for i in (0, 1)), pa.array(counts)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "lang", "word", "n"])

        for scanned, languages in scan(batches):
            found, at, n = np.unique(scanned.keys, return_index=True, return_counts=True)
            place = np.searchsorted(keys, found)
            known = np.zeros(len(found), bool)
            inside = place < len(keys)
            known[inside] = keys[place[inside]] == found[inside]
            counts[place[known]] += n[known]
            new = np.flatnonzero(~known)
            # names are kept in the order of the keys, too
            merged = np.concatenate([keys, found[new]])
            order = np.argsort(merged, kind="stable")
            texts_new = [(languages[scanned.text[i]], scanned.word(i)) for i in at[new]]
            both = names + texts_new
            keys, counts, names = merged[order], np.concatenate([counts, n[new]])[order], [both[i] for i in order]
            for t, m in zip(*np.unique(scanned.text, return_counts=True), strict=True):
                totals[languages[t]] = totals.get(languages[t], 0) + int(m)
            if len(keys) > HELD // 2:
                yield rows()
                keys, counts, names = np.empty(0, np.uint64), np.empty(0, np.int64), []
        if len(keys):
            yield rows()
        if totals:
            none = [pa.array([0] * len(totals), pa.int64()), pa.array(list(totals), pa.string()), pa.array([None] * len(totals), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(list(totals.values()), pa.int64())], names=["key", "lang", "word", "n"])

    each = texts.mapInArrow(run, "key long, lang string, word string, n long")
    return each.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")).where(f"n >= {least} or word is null")


def bit_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A bit array with the bits of the long column ``h`` set; at most FILTER_BITS / 64 rows reach the driver."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (64 * n).bit_length()))
    at = hashes.select(F.expr(f"h & {bits - 1}L").alias("at"))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = cells.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table["cell"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _pairs(scanned: Scanned, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word whether it and the one that follows may be frequent, and the hash of the two."""
    there = np.zeros(len(scanned.keys), bool)
    hashes = np.zeros(len(scanned.keys), np.uint64)
    if len(there):
        often = passes(words, scanned.keys)
        there[:-1] = scanned.next[:-1] & often[:-1] & often[1:]
        at = np.flatnonzero(there)
        hashes[at] = pair_hash(scanned.keys[at], scanned.keys[at + 1])
    return there, hashes


def _chain(keys: np.ndarray, there: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the suffixes that begin at ``at``, word after word: the word, 0 where the suffix has ended, and the hash so far."""
    # beyond the end of the slice no pair is there
    keys = np.concatenate([keys, np.zeros(MAX_WORDS, np.uint64)])
    there = np.concatenate([there, np.zeros(MAX_WORDS, bool)])
    whole, going = keys[at], np.ones(len(at), bool)
    yield whole, whole
    for k in range(1, MAX_WORDS):
        going = going & there[at + k - 1]
        word = np.where(going, keys[at + k], np.uint64(0))
        whole = pair_hash(whole, word)
        yield word, whole


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array ``known``."""
    at = np.searchsorted(known, hashes)
    out = np.zeros(len(hashes), bool)
    inside = at < len(known)
    out[inside] = known[at[inside]] == hashes[inside]
    return out


def prefix_counts(texts: DataFrame, words: np.ndarray, prefixes: np.ndarray | None = None, extended: tuple[np.ndarray, ...] = ()) -> DataFrame:
    """``h, n``: hashes of prefixes and how often they occur.

    Without ``extended`` these are the pairs of frequent words; with the sorted hashes of the extended prefixes of 2, 3, ...
    words they are those with one word more than the longest of them.
    """

    def run(batches):
        tally = Tally()

        def rows():
            hashes, counts = tally.take()
            return pa.RecordBatch.from_arrays([signed(hashes), pa.array(counts)], names=["h", "n"])

        for scanned, _ in scan(batches):
            there, hashes = _pairs(scanned, words)
            found = hashes[there]
            if extended:
                there &= passes(prefixes, hashes)
                steps = list(_chain(scanned.keys, there, np.flatnonzero(there & _among(hashes, extended[0]))))
                deep = np.ones(len(steps[0][0]), bool)
                for (_, whole), known in zip(steps[1:], extended, strict=False):
                    deep &= _among(whole, known)
                word, whole = steps[len(extended) + 1]
                found = whole[deep & (word != 0)]
            tally.add(found, found)
            if tally.full():
                yield rows()
        if tally.held:
            yield rows()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def partition(texts: DataFrame, words: np.ndarray, prefixes: np.ndarray, pairs: DataFrame, budget: int) -> tuple[list[np.ndarray], int]:
    """The sorted hashes of the prefixes of 2, 3, 4 words that are extended, and the number of groups.

    A prefix is extended if it has more suffixes than the budget, or than a quarter of a task's share of all. So at
    most suffixes / budget hashes of each length, or four for each task, come to the driver.
    """
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = shuffle_width(texts.sparkSession)
    most = max(1, min(budget, total // (4 * width)))
    extended, counted = [], pairs
    while len(extended) < MAX_WORDS - 2:
        heavy = counted.where(F.col("n") > most).select("h").toArrow()["h"].to_numpy().view(np.uint64)
        if not len(heavy):
            break
        extended.append(np.sort(heavy))
        if len(extended) < MAX_WORDS - 2:
            counted = prefix_counts(texts, words, prefixes, tuple(extended))
    return extended, max(4 * width, -(-2 * total // budget))


W = [f"w{i}" for i in range(1, MAX_WORDS + 1)]
_RUN = ", ".join(f"{c} array<long>" for c in [*W, "n"])


def suffixes(texts: DataFrame, words: np.ndarray, prefixes: np.ndarray, extended: list[np.ndarray], groups: int) -> DataFrame:
    """``grp, depth, w1 ... w5, n``: a task's suffixes of a group and its prefixes of ``depth`` words, as columns of one row.

    Suffixes begin with a frequent pair and are cut where a pair is too rare; 0 stands for no word.
    """

    def run(batches):
        tally = Tally()

        def rows():
            out, counts = tally.take()
            dealt, depth, whole = out[:, 0], np.full(len(out), 2), out[:, 0]
            for k in range(1, MAX_WORDS):
                whole = pair_hash(whole, out[:, k])
                dealt = np.where(depth == k + 1, whole, dealt)
                if k <= len(extended):
                    depth[(depth == k + 1) & _among(whole, extended[k - 1])] += 1
            group = (dealt % np.uint64(groups)).astype(np.int64) * 8 + depth
            order = np.argsort(group, kind="stable")
            group, columns = group[order], [*out[order].T.view(np.int64), counts[order]]
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = np.append(at, len(group)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(c))) for c in columns]
            heads = [pa.array(group[at] // 8), pa.array((group[at] % 8).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*heads, *lists], names=["grp", "depth", *W, "n"])

        for scanned, _ in scan(batches):
            there, hashes = _pairs(scanned, words)
            there &= passes(prefixes, hashes)
            steps = list(_chain(scanned.keys, there, np.flatnonzero(there)))
            tally.add(steps[-1][1], np.stack([w for w, _ in steps], 1))
            if tally.full():
                yield rows()
        if tally.held:
            yield rows()

    return texts.mapInArrow(run, f"grp long, depth int, {_RUN}")


def subtrees(dealt: DataFrame, least: int) -> DataFrame:
    """``words, n`` of the nodes of each group: frequent ones below a prefix, and the group's part of shorter ones."""

    def build(table: pa.Table) -> pa.Table:
        flat = {c: table[c].combine_chunks().flatten().to_numpy() for c in [*W, "n"]}
        depth = np.repeat(table["depth"].to_numpy(), pa.compute.list_value_length(table["n"]).to_numpy())
        rows = np.stack([flat[w] for w in W], 1)
        order = np.lexsort(rows.T[::-1])
        rows, depth = rows[order], depth[order]
        leaves = np.concatenate([[0], np.cumsum(flat["n"][order])])
        new = np.zeros(len(rows), bool)
        new[0] = True
        words, counts = [], []
        for k in range(MAX_WORDS):
            new[1:] |= rows[1:, k] != rows[:-1, k]
            if not k:
                continue
            at = np.flatnonzero(new)
            n = leaves[np.append(at[1:], len(rows))] - leaves[at]
            # an extended prefix has parts in several groups, which only together may be frequent
            keep = (rows[at, k] != 0) & ((n >= least) | (depth[at] > k + 1))
            words.append(pa.array(list(rows[at[keep], : k + 1]), pa.list_(pa.int64())))
            counts.append(pa.array(n[keep]))
        return pa.table({"words": pa.chunked_array(words), "n": pa.chunked_array(counts)})

    found = dealt.groupBy("grp").applyInArrow(build, "words array<long>, n long")
    return found.groupBy("words").agg(F.sum("n").alias("n")).where(f"n >= {least}")


# ---- collocations -----------------------------------------------------------------------


def phrase_counts(texts: DataFrame, words: DataFrame, least: int, budget: int) -> DataFrame:
    """``words, n`` of all phrases of up to MAX_WORDS words that occur at least ``least`` times.

    ``words`` here are keys; the table ``words`` is what ``word_counts`` gives.
    """
    single = words.where("word is not null").select(F.col("key").alias("h"))
    often = bit_filter(single, single.count())
    pairs = settle(prefix_counts(texts, often).where(f"n >= {least}"), "phrase-pairs")
    begins = bit_filter(pairs.select("h"), pairs.count())
    extended, groups = partition(texts, often, begins, pairs, budget)
    discard(pairs)
    found = subtrees(suffixes(texts, often, begins, extended, groups), least)
    return settle(found.unionByName(words.where("word is not null").select(F.array("key").alias("words"), "n")), "phrase-counts")


#: In decimals, as the products may pass 64 bits.
_WIDE = "cast({} as decimal(19, 0))".format
SCORE = f"cast(1000 as decimal(4, 0)) * {_WIDE('a')} * {_WIDE('total')} div ({_WIDE('l')} * {_WIDE('r')})"


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """``words, lang, a, l, r, n, score`` of the phrases of two words or more that no equally frequent longer one holds."""
    phrases = counts.where("size(words) > 1").select("words", F.col("n").alias("a"))
    cuts = phrases.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    left = "struct('l' AS side, slice(words, 1, k) AS part)"
    right = "struct('r' AS side, slice(words, k + 1, size(words) - k) AS part)"
    sides = cuts.select("words", "a", "k", F.inline(F.expr(f"array({left}, {right})")))
    known = counts.select(F.col("words").alias("part"), F.col("n").alias("f"))
    looked = settle(sides.join(known, "part"), "phrase-parts")
    # a longer phrase that is as frequent has one word more, or holds one that has
    within = looked.where("size(part) > 1 and size(part) = size(words) - 1 and f = a").select(F.col("part").alias("words")).distinct()
    halves = looked.groupBy("words", "a", "k").agg(F.max(F.expr("if(side = 'l', f, null)")).alias("l"), F.max(F.expr("if(side = 'r', f, null)")).alias("r"))
    named = words.where("word is not null").select("key", "lang").join(
        words.where("word is null").select("lang", F.col("n").alias("total")), "lang"
    )
    rated = halves.join(within, "words", "left_anti").withColumn("key", F.expr("words[0]")).join(named, "key")
    rated = rated.withColumn("score", F.expr(SCORE))
    lowest = rated.groupBy("words", "lang", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("words", "lang", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def ranked(phrases: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, with their text."""
    # the best of each part of a language hold the best of all; ties with the last stay until the text decides
    order = [F.col("score").desc(), F.col("a").desc()]
    part = F.pmod(F.xxhash64("words"), F.lit(PARTS))
    best = phrases.withColumn("part", part).withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.where(f"place <= {top}").withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order)))
    best = settle(best.where(f"place <= {top}").drop("place", "part"), "phrase-best")
    spelled = (
        best.select("words", F.posexplode("words").alias("i", "key"))
        .join(words.where("word is not null").select("key", "word"), "key")
        .groupBy("words")
        .agg(F.expr("array_join(transform(array_sort(collect_list(struct(i, word))), x -> x.word), ' ')").alias("phrase"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    listed = best.join(spelled, "words").withColumn("rank", place.cast("long")).where(f"rank <= {top}")
    return listed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(documents: DataFrame, least: int = MIN_COUNT, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest collocations of each language.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs. A phrase has 2 to
    MAX_WORDS words of one piece and occurs ``a >= least`` times, overlaps included. Of its cuts into two parts of
    ``l`` and ``r`` occurrences the one with the lowest ``score = floor(1000 a n / (l r))`` counts, the first on a tie;
    ``n`` are the words of the language. Phrases within a longer one that occurs as often are left out.
    Ranks go by score, count and text. A null language is ``und``; a null text is empty; each of repeated rows
    counts; other columns are ignored. An empty table gives no rows. ``a n`` must stay below 10^35.
    """
    spark: SparkSession = documents.sparkSession
    bound_batches(spark)
    texts = documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    words = settle(word_counts(texts, least), "phrase-words")
    counts = phrase_counts(texts, words, least, budget)
    return ranked(scored(counts, words), words, top)


#: The same over the whole table ``documents`` in plain SQL.
COLLOCATIONS_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, ws[i:i + m - 1] AS g, m FROM (
    SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM lists, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, g, m, count(*) AS a FROM grams GROUP BY ALL),
cand AS (SELECT * FROM f WHERE m > 1 AND a >= {MIN_COUNT}),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
rated AS (
  SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, t.n,
    CAST(1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, g[i:i + p - 1] AS g, max(a) AS most FROM (
    SELECT lang, g, a, p, unnest(range(1, m - p + 2)) AS i FROM (SELECT lang, g, a, m, unnest(range(2, m)) AS p FROM cand)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_parts i USING (lang, g) WHERE i.most IS NULL OR 100 * i.most < 100 * b.a)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank,
    array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM kept) WHERE rank <= {TOP}
"""
