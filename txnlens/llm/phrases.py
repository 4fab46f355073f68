"""Phrases whose words occur together far more often than by chance.

Counts of runs of up to five words are kept as weighted acyclic automata. A shard of texts sorts its
runs and builds one from them: a run adds states where it leaves the run before it, and a state's
weight is the number of runs through it. The parts of all shards in one range of prefixes are then
united length by length, weights of equal paths added, and paths too rare for a phrase cut off. The
counts of a phrase's parts are looked up among the paths that are left.

That is done twice, for runs of two words and then for longer ones, which need no states behind a
pair of words that is too rare.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.kernels import mix, texts
from txnlens.operators.joins import BROADCAST_BYTES, lookup_join, table_bytes
from txnlens.operators.keys import sums_before, row_ids
from txnlens.session import materialize, shuffle_partitions

LONGEST = 5
# Bytes of text that a task cuts into words at once, and words whose runs it sorts at once.
SHARD_BYTES = 8 << 20
SORTED_WORDS = 1 << 20
# Words of a row of a numbered text, about.
ROW_WORDS = 1 << 16
# States that are united at once, unless one place has more.
UNITED_STATES = 1 << 19
# Runs that are united in one place: a range of first words, or of next words behind a prefix with more
# runs than that. There are at most MOST_PLACES prefixes of a length and ranges of first words, so
# this number grows with corpora of over 2**38 words.
PLACE_RUNS = 1 << 18
MOST_PLACES = 1 << 20
# Bits of the filter of frequent pairs: 16 a pair, up to 64 MB; fuller, it only prunes less.
FILTER_BITS = (1 << 16, 1 << 29)
FILTER_PARTS = 256
# Words of up to so many bytes are sent to all tasks; more are joined.
BROADCAST_WORDS = BROADCAST_BYTES
# Parts in which a language is ranked before the best of each meet.
RANKED_APART = 64

# Bytes that end a piece become full stops, tabs blanks, A-Z lower case.
_FOLD = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SHARD = "lang string, words array<string>, n array<long>, codes binary"
_RUN = "lang string, ids array<int>, a long"


def _part(longest: int) -> str:
    """A part of an automaton: its place, and by length the states there in order, each with its word,
    its weight and how many states of the next length follow it.

    The place is a prefix of words and, below zero, the range of the next word.
    """
    return "lang string, place array<int>" + "".join(f", word{k} array<int>, fan{k} array<int>, weight{k} array<int>" for k in range(1, longest + 1))


def _names(schema: str) -> list[str]:
    return [field.split(" ")[0] for field in schema.split(", ")]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a column of lists."""
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64), bounds - bounds[0]


def _coded(lang: str, parts: list[bytes]) -> pa.RecordBatch:
    """One shard: its words with their counts, and its texts as places in that list, -1 between pieces."""
    places: dict[bytes, int] = defaultdict(count().__next__)
    stop, blank = places[b"."], places[b""]
    tokens = b".".join(parts).translate(_FOLD).replace(b".", b" . ").split(b" ")
    codes = np.fromiter(map(places.__getitem__, tokens), np.int32, len(tokens))
    codes = codes[codes != blank]
    n = np.bincount(codes, minlength=len(places))
    n[[stop, blank]] = 0
    codes[codes == stop] = -1
    row = [[lang], [[w.decode() for w in places]], [n.tolist()], [codes.tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in row], _names(_SHARD))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a task, by language, in shards."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        rows = texts(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            text = rows.row(i)
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= SHARD_BYTES:
                yield from (_coded(k, v) for k, v in held.items())
                held, size = {}, 0
    yield from (_coded(k, v) for k, v in held.items())


def _rows(lang: str, ids: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """A numbered text in rows that end between pieces, without what has no runs."""
    rows = []
    ends = np.flatnonzero(ids < 0)
    at = 0
    while at < len(ids):
        later = ends[np.searchsorted(ends, at + ROW_WORDS) :]
        stop = int(later[0]) + 1 if len(later) else len(ids)
        part = ids[at:stop]
        word = part >= 0
        # Words without neighbours have no runs, and one end between words is enough.
        beside = np.zeros(len(part), bool)
        beside[1:] |= word[1:] & word[:-1]
        beside[:-1] |= word[:-1] & word[1:]
        keep = beside.copy()
        keep[1:] |= ~beside[1:] & beside[:-1]
        rows.append((lang, np.where(beside, part, -1)[keep]))
        at = stop
    return rows


def _table(rows: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    bounds = np.cumsum([0, *(len(ids) for _, ids in rows)])
    flat = np.concatenate([ids for _, ids in rows]) if rows else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in rows], pa.string()), _lists(flat, bounds)], ["lang", "ids"])


def _number(shard: pa.Table, known: pa.Table) -> pa.Table:
    """The texts of a shard with the corpus' numbers of words; -1 stands for all others and between pieces."""
    rows = []
    for lang, codes in zip(shard.column("lang").to_pylist(), shard.column("codes").to_pylist()):
        codes = np.frombuffer(codes, np.int32)
        numbers = np.full(int(codes.max(initial=-1)) + 2, -1, np.int32)  # the last one is that of -1
        numbers[known.column("place").to_numpy()] = known.column("id").to_numpy()
        rows += _rows(lang, numbers[codes])
    return pa.Table.from_batches([_table(rows)])


def _numbered(coded: DataFrame, listed: DataFrame, words: DataFrame) -> DataFrame:
    """``(lang, ids)``: the texts as numbers of frequent words, -1 between pieces and for other words.

    A table of words of bounded size goes to the shards; of a larger one each shard gets the words
    that it has.
    """
    if table_bytes(words.select("lang", "word", "id")) <= BROADCAST_WORDS:
        # At most BROADCAST_WORDS bytes.
        found: dict[str, dict[str, int]] = {}
        for row in words.select("lang", "word", "id").toLocalIterator():
            found.setdefault(row["lang"], {})[row["word"]] = row["id"]
        shared = coded.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, own, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    known = shared.value.get(lang, {})
                    numbers = np.array([*(known.get(w, -1) for w in own.values.to_pylist()), -1], np.int32)
                    yield _table(_rows(lang, numbers[np.frombuffer(codes.as_buffer(), np.int32)]))

        return coded.select("lang", "words", "codes").mapInArrow(run, "lang string, ids array<int>")
    key = F.concat(F.hex("lang"), F.lit("\t"), F.col("word"))
    held = lookup_join(listed.select("shard", "place", key.alias("_key")), words.select(key.alias("_key"), "id"), "_key", spread="shard")
    shards = coded.select("shard", "lang", "codes").groupBy("shard")
    return shards.cogroup(held.select(F.col("shard").alias("of"), "place", "id").groupBy("of")).applyInArrow(_number, "lang string, ids array<int>")


def _bits(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of the filter that a pair of words belongs to, and its three bits there."""
    first = mix(pairs.astype(np.uint64))
    second = mix(first + np.uint64(1))
    part = (first & np.uint64(FILTER_PARTS - 1)).astype(np.int64)
    places = np.stack([first >> np.uint64(40), second >> np.uint64(40), second & np.uint64((1 << 24) - 1)], axis=1)
    return part, (places & np.uint64(bits - 1)).astype(np.int64)


def _pair_filter(pairs: DataFrame, n: int) -> np.ndarray:
    """A bit filter that lets all frequent pairs ``(ids)`` pass, one row of bytes for each of its parts."""
    bits = max(FILTER_BITS[0], min(FILTER_BITS[1], 1 << (16 * n).bit_length())) // FILTER_PARTS

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy().astype(np.int64)
            part, places = _bits(ids[::2] << 32 | ids[1::2], bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, 3)), pa.array(places.reshape(-1))], ["part", "bit"])

    def filled(table: pa.Table) -> pa.Table:
        set_bits = np.zeros(bits, np.uint8)
        set_bits[table["bit"].to_numpy()] = 1
        return pa.table({"part": table["part"].slice(0, 1), "bytes": pa.array([np.packbits(set_bits).tobytes()])})

    # A bit counts once, so that a part of the filter never gets more rows than it has bits.
    places = pairs.select("ids").mapInArrow(placed, "part long, bit long").distinct()
    parts = places.groupBy("part").applyInArrow(filled, "part long, bytes binary")
    out = np.zeros((FILTER_PARTS, bits // 8), np.uint8)
    for row in parts.collect():  # FILTER_PARTS rows, 64 MB at most
        out[row["part"]] = np.frombuffer(row["bytes"], np.uint8)
    return out


def _without_rare_pairs(ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether a run may go on from each word to the next."""
    if len(ids) < 2:
        return np.zeros(len(ids), bool)
    both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    part, places = _bits(ids[both].astype(np.int64) << 32 | ids[both + 1], pairs.shape[1] * 8)
    hit = np.ones(len(both), bool)
    for k in range(3):
        hit &= (pairs[part, places[:, k] >> 3] >> (7 - (places[:, k] & 7))) & 1 == 1
    out = np.zeros(len(ids), bool)
    out[both[hit]] = True
    return out


def _runs(ids: np.ndarray, longest: int = LONGEST, goes_on: np.ndarray | None = None) -> np.ndarray:
    """The run of words that begins at each word, a row each; -1 from where it ends on."""
    padded = np.concatenate([ids, np.full(longest, -1, ids.dtype)])
    goes_on = np.concatenate([np.ones(len(ids), bool) if goes_on is None else goes_on, np.zeros(longest, bool)])
    columns = [padded[: len(ids)]]
    for k in range(1, longest):
        columns.append(np.where((columns[-1] >= 0) & goes_on[k - 1 : k - 1 + len(ids)], padded[k : k + len(ids)], -1))
    return np.stack(columns, axis=1)[ids >= 0]


def _sorted(runs: np.ndarray) -> np.ndarray:
    wide = runs.astype(np.int64) + 1
    keys = [wide[:, k] << 32 | wide[:, k + 1] if k + 1 < runs.shape[1] else wide[:, k] for k in range(0, runs.shape[1], 2)]
    return runs[np.lexsort(keys[::-1])]


def _leaves(runs: np.ndarray) -> list[np.ndarray]:
    """For each length, the rows of sorted runs whose path of that length is not that of the row before."""
    new = np.zeros(len(runs), bool)
    new[:1] = True
    out = []
    for k in range(runs.shape[1]):
        new[1:] |= runs[1:, k] != runs[:-1, k]
        out.append(new.copy())
    return out


def _build(lang: str, runs: np.ndarray, hot: list[dict], ranges: np.ndarray) -> pa.RecordBatch | None:
    """The automaton of one shard's runs, cut into the parts that are united in one place each.

    ``hot`` has, by length, the paths with more runs than one place unites, and how many places the
    runs behind them are dealt to, by ranges of the next word; those that end there are counted with
    them. ``ranges`` has the first word of each range.
    """
    longest = runs.shape[1]
    runs = _sorted(runs)
    depth = np.zeros(len(runs), np.int64)
    dealt = np.full(len(runs), len(ranges), np.int64)
    leaves = _leaves(runs)
    through = np.ones(len(runs), bool)
    for k, paths in enumerate(hot[: longest - 1]):
        first = np.flatnonzero(leaves[k])
        places = np.array([paths.get((lang, *runs[i, : k + 1].tolist()), 0) if through[i] else 0 for i in first], np.int64)
        if not places.any():
            break
        places = places[np.cumsum(leaves[k]) - 1]
        through &= places > 0
        depth[through] = k + 1
        dealt[through] = places[through]
    following = runs[np.arange(len(runs)), depth]
    whole = following >= 0
    runs, depth, dealt, following = runs[whole], depth[whole], dealt[whole], following[whole]
    if not len(runs):
        return None
    within = (np.searchsorted(ranges, following, side="right") - 1) * dealt // len(ranges)
    leaves = np.stack(_leaves(runs))
    # A place goes on while the prefix and the range of the next word do.
    begins = np.ones(len(runs), bool)
    begins[1:] = (depth[1:] != depth[:-1]) | (within[1:] != within[:-1]) | ((depth[1:] > 0) & leaves[np.maximum(depth[1:] - 1, 0), np.arange(1, len(runs))])
    start = np.flatnonzero(begins)
    bounds = np.concatenate([[0], np.cumsum(depth[start] + 1)])
    prefix = np.arange(bounds[-1]) - np.repeat(bounds[:-1], depth[start] + 1)
    cells = runs[np.repeat(start, depth[start] + 1), np.minimum(prefix, longest - 1)]
    cells[bounds[1:] - 1] = -1 - within[start]
    columns = [pa.array([lang] * len(start)), _lists(cells, bounds)]
    rows, weights = [], []
    for k in range(longest):
        first = np.flatnonzero(leaves[k])
        state = (runs[first, k] >= 0) & (depth[first] <= k)
        rows.append(first[state])
        weights.append(np.diff(np.append(first, len(runs)))[state])
    for k in range(longest):
        cut = np.searchsorted(rows[k], np.append(start, len(runs)))
        fan = np.zeros(len(rows[k]), np.int64)
        if k + 1 < longest and len(rows[k]):
            # States whose path is one word longer than their place's prefix have no state before them.
            inner = rows[k + 1][depth[rows[k + 1]] <= k]
            fan = np.bincount(np.searchsorted(rows[k], inner, side="right") - 1, minlength=len(rows[k]))
        columns += [_lists(runs[rows[k], k], cut), _lists(fan, cut), _lists(weights[k], cut)]
    return pa.RecordBatch.from_arrays(columns, _names(_part(longest)))


def _united(parts: pa.Table, least: int, shortest: int) -> pa.RecordBatch:
    """Paths of at least ``shortest`` words and ``least`` runs, in parts that hold whole places."""
    parts = parts.combine_chunks()
    column = {name: parts.column(name).chunk(0) for name in parts.column_names}
    longest = (len(column) - 2) // 3
    numbers: dict[tuple, int] = {}
    named = zip(column["lang"].to_pylist(), column["place"].to_pylist())
    place = np.array([numbers.setdefault((lang, *ids), len(numbers)) for lang, ids in named], np.int64)
    places = [path[:-1] for path in numbers]
    depth = np.array([len(path) - 1 for path in places], np.int64)[place]
    out: list[tuple[tuple, int]] = []
    before: list[tuple] = []  # paths left of one word less, behind their places
    behind = np.zeros(0, np.int64)  # for each state of this length that has one before it: which of those
    for k in range(1, longest + 1):
        word, bounds = _flat(column[f"word{k}"])
        weight, fan = _flat(column[f"weight{k}"])[0], _flat(column[f"fan{k}"])[0]
        part = np.repeat(np.arange(len(place)), np.diff(bounds))
        direct = depth[part] == k - 1
        parent = np.empty(len(word), np.int64)
        parent[direct] = place[part[direct]]
        parent[~direct] = np.where(behind < 0, -1, behind + len(places))
        alive = np.flatnonzero(parent >= 0)
        order = alive[np.lexsort((word[alive], parent[alive]))]
        opens = np.ones(len(order), bool)
        opens[1:] = (parent[order][1:] != parent[order][:-1]) | (word[order][1:] != word[order][:-1])
        first = np.flatnonzero(opens)
        summed = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)
        keep = summed >= least
        above = [*places, *before]
        before = [(*above[p], w) for p, w in zip(parent[order[first[keep]]].tolist(), word[order[first[keep]]].tolist())]
        if k >= shortest:
            out += zip(before, summed[keep].tolist())
        state = np.full(len(word), -1, np.int64)
        state[order] = np.where(keep, np.cumsum(keep) - 1, -1)[np.cumsum(opens) - 1]
        behind = np.repeat(state, fan)
    columns = [
        pa.array([path[0] for path, _ in out], pa.string()),
        pa.array([path[1:] for path, _ in out], pa.list_(pa.int32())),
        pa.array([a for _, a in out], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, _names(_RUN))


def _whole_places(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.Table]:
    """Parts sorted by place, in tables of about UNITED_STATES that end where a place does."""
    held: list[pa.RecordBatch] = []
    size, before = 0, None
    for batch in batches:
        places = list(zip(batch.column(0).to_pylist(), map(tuple, batch.column(1).to_pylist())))
        states = sum(np.diff(batch.column(f"word{k}").offsets.to_numpy()) for k in range(1, longest + 1))
        at = 0
        for i, place in enumerate(places):
            if size >= UNITED_STATES and place != before:
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, size, at = [], 0, i
            size, before = size + int(states[i]), place
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _count(numbered: DataFrame, least: int, longest: int, shortest: int, hot: list[dict], ranges: np.ndarray, pairs: np.ndarray | None = None) -> DataFrame:
    """``(lang, ids, a)``: runs of ``shortest`` to ``longest`` words with ``a >= least``, by uniting the shards' automata.

    ``pairs`` is a filter that lets all frequent pairs pass; runs end at others.
    """
    spark = numbered.sparkSession
    shared = spark.sparkContext.broadcast((hot, ranges, pairs))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, ranges, pairs = shared.value
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def built() -> Iterator[pa.RecordBatch]:
            for lang, runs in waiting.items():
                made = _build(lang, np.concatenate(runs), hot, ranges)
                if made is not None:
                    yield made

        for batch in batches:
            for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids.values.to_numpy(zero_copy_only=False)
                runs = _runs(ids, longest, None if pairs is None else _without_rare_pairs(ids, pairs))
                runs = runs[runs[:, shortest - 1] >= 0]
                if len(runs):
                    waiting.setdefault(lang, []).append(runs)
                size += len(runs)
                if size >= SORTED_WORDS:
                    yield from built()
                    waiting, size = {}, 0
        yield from built()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_places(batches, longest):
            yield _united(table, least, shortest)

    parts = numbered.mapInArrow(build, _part(longest)).repartition(shuffle_partitions(spark), "lang", "place")
    return parts.sortWithinPartitions("lang", "place").mapInArrow(unite, _RUN)


def _hot_paths(numbered: DataFrame, found: list[dict], limit: int) -> list[dict]:
    """Go on with ``found``, which has the paths of one and of two words with more than ``limit`` runs
    and how many: longer ones are counted length by length, only behind those found.

    There are at most as many of a length as ``limit`` goes into the words of the corpus.
    """
    spark = numbered.sparkSession
    while found[-1] and len(found) < LONGEST - 1:
        length = len(found) + 1
        shared = spark.sparkContext.broadcast(found[-1])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, length=length) -> Iterator[pa.RecordBatch]:
            heads: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if lang not in heads:
                        heads[lang] = np.unique([path[1] for path in shared.value if path[0] == lang])
                    runs = _runs(ids.values.to_numpy(zero_copy_only=False), length)
                    runs = _sorted(runs[np.isin(runs[:, 0], heads[lang]) & (runs[:, length - 1] >= 0)])
                    first = np.flatnonzero(_leaves(runs)[-1])
                    n = np.diff(np.append(first, len(runs)))
                    keep = [(lang, *path[:-1]) in shared.value for path in runs[first].tolist()]
                    paths, n = runs[first][keep], n[keep]
                    lists = _lists(paths.reshape(-1), np.arange(len(paths) + 1) * length)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), lists, pa.array(n.astype(np.int64))], _names(_RUN))

        counted = numbered.mapInArrow(run, _RUN).groupBy("lang", "ids").agg(F.sum("a").alias("a"))
        found.append({(r[0], *r[1]): r[2] for r in counted.filter(F.col("a") > limit).collect()})
    return found


def count_runs(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of words and of longer runs, each from ``least`` on, and all words of each language.

    ``(lang, id, word, f)``, ``(lang, ids, a)`` with runs of 2 to 5 words as ids, and ``(lang, n)``.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    coded = slim.mapInArrow(_shards, _SHARD).withColumn("shard", F.monotonically_increasing_id())
    coded = materialize(coded, "shards")
    # A word of a shard is one row, however often it occurs there.
    listed = coded.select("shard", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("place", "_w"))
    listed = listed.select("shard", "lang", "place", F.col("_w.words").alias("word"), F.col("_w.n").alias("n")).filter("n > 0")
    counted = materialize(listed.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(PLACE_RUNS, total // MOST_PLACES)
    # A phrase has no word that is rarer than itself.
    words = row_ids(counted.filter(F.col("f") >= least), ["lang", "word"], "id").withColumn("id", F.col("id").cast("int"))
    words = sums_before(words, ["id"], "f").select("lang", "id", "word", "f", F.floor(F.col("_before") / limit).alias("range"))
    ranges = np.sort(np.array([r["first"] for r in words.groupBy("range").agg(F.min("id").alias("first")).collect()], np.int64))
    if not len(ranges):
        return words, spark.createDataFrame([], _RUN), sizes
    ranges[0] = 0

    numbered = materialize(_numbered(coded, listed, words), "numbered")
    hot = [{(r[0], r[1]): r[2] for r in words.filter(F.col("f") > limit).select("lang", "id", "f").collect()}]
    places = lambda found: [{path: -(-n // limit) for path, n in paths.items()} for paths in found]
    pairs = materialize(_count(numbered, least, 2, 2, places(hot), ranges), "pairs")
    frequent = pairs.count()
    hot.append({(r[0], *r[1]): r[2] for r in pairs.filter(F.col("a") > limit).collect()})
    hot = _hot_paths(numbered, hot, limit)
    longer = _count(numbered, least, LONGEST, 3, places(hot), ranges, _pair_filter(pairs, frequent))
    followed = [(path[0], list(path[1:]), n) for paths in hot[2:] for path, n in paths.items()]
    runs = pairs.unionByName(longer).unionByName(spark.createDataFrame(followed, _RUN))
    return words, materialize(runs, "runs"), sizes


def _path_key(ids: Column) -> Column:
    """A path of words as one text; numbers of words tell the languages apart."""
    return F.array_join(ids.cast("array<string>"), ",")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are lower-cased (A-Z alone) and cut into pieces at ``. , ; : ! ?`` and line ends, pieces
    into words at blanks and tabs. A phrase is a run of two to five words of one piece that occurs
    ``a >= least`` times, overlaps included; its score is that of its weakest cut, floor(1000 * a * n
    / (l * r)), where its parts occur ``l`` and ``r`` times and the language has ``n`` words. Phrases
    inside a longer one that occurs as often go. A null language is ``und``, null texts are empty;
    every row counts, also repeated ones; other columns are not looked at.
    """
    words, runs, sizes = count_runs(docs, least)
    single = words.select("lang", F.array("id").alias("ids"), F.col("f").alias("a"))
    every = materialize(runs.unionByName(single).select(_path_key(F.col("ids")).alias("_key"), "a"), "paths")
    size = table_bytes(every)
    cuts = runs.select(_path_key(F.col("ids")).alias("_phrase"), "lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", _path_key(F.slice("ids", F.lit(1), F.col("k"))).alias("_left"), _path_key(F.slice("ids", F.col("k") + 1, F.size("ids"))).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = lookup_join(cuts, every.select(F.col("_key").alias(side), F.col("a").alias(name)), side, spread="_phrase", dim_bytes=size)
    cuts = materialize(cuts.join(F.broadcast(sizes) if table_bytes(sizes) <= 8 << 20 else sizes, "lang"), "cuts")

    exact = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    cuts = cuts.withColumns({"_over": F.lit(1000).cast("decimal(4,0)") * exact[0], "_n": exact[1], "_under": exact[2] * exact[3]})
    cuts = cuts.withColumn("score", F.expr("(cast(_over as decimal(19,0)) * _n) div _under"))
    weakest = cuts.groupBy("_phrase", "lang", "n").agg(
        F.first("ids").alias("ids"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("_cut")
    )
    # A run is inside a longer one that occurs as often if it is inside such a one of one word more.
    longer = cuts.filter(F.size("ids") > 2)
    inside = longer.filter((F.col("k") == 1) & (F.col("a") >= F.col("r"))).select(F.col("_right").alias("_phrase")).unionByName(
        longer.filter((F.col("k") == F.size("ids") - 1) & (F.col("a") >= F.col("l"))).select(F.col("_left").alias("_phrase"))
    )
    kept = materialize(weakest.join(inside.distinct(), "_phrase", "left_anti"), "kept")

    spelled = kept.select("_phrase", F.posexplode("ids").alias("_at", "id"))
    spelled = lookup_join(spelled, words.select("id", "word"), "id", spread="_phrase")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ")
    spelled = spelled.groupBy("_phrase").agg(phrase.alias("phrase"))
    found = kept.join(spelled, "_phrase").select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")

    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    apart = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART))
    found = found.withColumn("_apart", apart).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_apart").orderBy(*best)))
    found = found.filter(F.col("_rank") <= top).drop("_rank", "_apart")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
