"""Near-duplicate documents: Jaccard join of word shingles with a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, materialise, partitions, slices
from .set_links import SetIndex, Stars
from .words_np import WordHashes, grams, hashes_of, mixed, whole

SHINGLE = 5
#: Documents link when PERCENT percent of the union at least is common.
PERCENT = 80
#: A group holds about so many sets and tokens at most; larger ones are split, by a second min-hash and then by set.
GROUP_SETS, GROUP_TOKENS = 2_000, 1_000_000
#: Prefixes are longer than they need be by n / EXTRA tokens, and ask for as many more in common.
EXTRA = 20
#: Counts of groups by token are told apart up to here; they only order a set's tokens.
MANY = 4_096


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes: of 5 words each, or of all words where there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    h = hashes_of(words, known)
    return np.unique(grams(h, SHINGLE).view(np.int64)) if len(h) >= SHINGLE else np.array([whole(h)], dtype=np.uint64).view(np.int64)


def set_id(tokens: np.ndarray) -> int:
    """64-bit identity of a set, from its sorted members."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        place = mixed(np.arange(1, len(tokens) + 1, dtype=np.uint64))
        return int(mixed(np.array([(tokens.view(np.uint64) * (place | np.uint64(1))).sum()], dtype=np.uint64)).view(np.int64)[0])


def needed(n: int) -> int:
    """Common shingles that a set of n needs at least with any partner."""
    return -(-n * PERCENT // 100)


def prefix(n: int) -> int:
    """Any so many tokens of a set of n have 1 + n // EXTRA at least in common with each of its partners."""
    return min(n, n - needed(n) + 1 + n // EXTRA)


def _least_common(n: Column) -> Column:
    """What a set of n has in common at least between its own prefix and that of a partner, in one order of all tokens."""
    return 1 + F.floor(F.floor(n * PERCENT / 100) / EXTRA)


def _tokens(values: bytes) -> np.ndarray:
    return np.frombuffer(values, dtype=np.int64)


def heads(docs: DataFrame) -> DataFrame:
    """doc_id, node (id of the shingle set), n, head: the smallest hashes of the set, prefix(n) of them, 8 bytes each.

    Two sets that link share as many of their heads as the smaller one's twentieth, plus 1 (prefix filter).
    """
    importable(docs.sparkSession)

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in parts:
            for piece in slices(part, 1):
                nodes, sizes, heads_ = [], [], []
                for t in piece.column(1).to_pylist():
                    s = shingle_set(t, known)
                    nodes.append(set_id(s))
                    sizes.append(len(s))
                    heads_.append(s[: prefix(len(s))].tobytes())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads_, pa.binary())], names=["doc_id", "node", "n", "head"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(parse, "doc_id bigint, node bigint, n bigint, head binary")


def _flat(lists: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """token, key of all members of the lists, sorted by token."""
    tokens = np.concatenate([np.empty(0, np.int64), *map(_tokens, lists)])
    owner = np.repeat(keys, [len(x) // 8 for x in lists])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order]


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(tokens)))


def _numbers(part: pa.RecordBatch, column: int) -> np.ndarray:
    return part.column(column).to_numpy(zero_copy_only=False)


#: Rows (token, key, kind) on their way to the pass that meets equal tokens: known to be alone in their batch, to be shared with others of it, or telling of such others.
ALONE, SHARED, TELLS = 0, 1, 2


def met_tokens(lists: DataFrame, key: str, values: str) -> DataFrame:
    """token, key, many for the members of the lists (key, values) that another key has too; a key stands in one row of
    lists, with a member once. many: about how many keys have it, MANY at most.

    A token that several keys of one batch have is known to be shared: those rows pass, and one row for the batch goes
    where the token is dealt. The others meet there in a sorted pass that holds MANY rows. So a token of very many
    keys is one row a batch where it is dealt, and its other rows go by their keys.
    """

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tokens, owner = _flat(part.column(1).to_pylist(), _numbers(part, 0).astype(np.int64))
            starts, lengths = _runs(tokens)
            several = lengths > 1
            inside = np.repeat(several, lengths)
            many = np.concatenate([lengths, np.repeat(lengths, lengths)[inside]])
            token, owned = np.concatenate([tokens[starts], tokens[inside]]), np.concatenate([owner[starts], owner[inside]])
            kind = np.concatenate([np.where(several, TELLS, ALONE), np.full(int(inside.sum()), SHARED)])
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(owned), pa.array(kind.astype(np.int32)), pa.array(many.astype(np.int32))], names=["token", "key", "kind", "many"])

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
        shared_before = False  # whether the first run held has had rows before

        def found(rows: list[np.ndarray], before: bool) -> pa.RecordBatch:
            token, owner, kind, many = rows
            starts, lengths = _runs(token)
            total = np.add.reduceat(np.where(kind == SHARED, 0, many), starts) if len(starts) else lengths
            if before and len(total):
                total[0] = MANY
            among = np.minimum(np.repeat(total, lengths), MANY)
            out = (kind == SHARED) | ((kind == ALONE) & (among > 1))
            return pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(owner[out]), pa.array(np.maximum(among, many)[out].astype(np.int32))], names=["token", "key", "many"])

        for part in parts:
            held = [np.concatenate([h, _numbers(part, i)]) for i, h in enumerate(held)]
            token = held[0]
            last = int(np.searchsorted(token, token[-1])) if len(token) else 0
            if len(token) - last > MANY:  # a long run needn't be seen to its end
                yield found(held, shared_before)
                shared_before, held = True, [h[-1:] for h in held]
                held[2], held[3] = np.full(1, TELLS, np.int32), np.full(1, MANY, np.int32)
            elif last:
                yield found([h[:last] for h in held], shared_before)
                shared_before, held = False, [h[last:] for h in held]
        if len(held[0]):
            yield found(held, shared_before)

    rows = lists.select(F.col(key).cast("bigint"), values).mapInArrow(deal, "token bigint, key bigint, kind int, many int")
    place = F.when(F.col("kind") == SHARED, F.xxhash64("key")).otherwise(F.col("token"))
    dealt = rows.repartition(partitions(lists.sparkSession), place).sortWithinPartitions("token")
    return dealt.mapInArrow(meet, "token bigint, key bigint, many int")


def candidates(parsed: DataFrame) -> DataFrame:
    """node, rep (least doc_id), n and group of the sets whose heads have enough in common with others to link.

    Similar sets have the least of their shared head tokens alike: that is the group. One that would be too large is
    split by the least in another order, and by set where that leaves it too large; nothing is dropped, as the
    matrix step compares across groups.
    """
    full = parsed.where("n > 0")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    lists = full.groupBy("node").agg(F.first("head").alias("head"))
    met = met_tokens(lists, "node", "head").groupBy(F.col("key").alias("node")).agg(F.count(F.lit(1)).alias("shared"), F.min("token").alias("first"), F.min(F.xxhash64("token")).alias("second"))
    found = nodes.join(met, "node").where((F.col("shared") >= _least_common(F.col("n"))) & F.col("rep").isNotNull())
    found = materialise(found.select("node", "rep", "n", "first", "second"), "candidates")

    def split(rows: DataFrame, by: str, salt: Column) -> DataFrame:
        parts = F.ceil(F.greatest(F.sum("n") / GROUP_TOKENS, F.count(F.lit(1)) / GROUP_SETS))
        large = rows.groupBy(by).agg(parts.alias("parts")).where("parts > 1")
        return rows.join(large, by, "left").withColumn(by, F.when(F.col("parts") > 1, F.xxhash64(by, F.pmod(salt, F.col("parts")))).otherwise(F.col(by))).drop("parts")

    once = split(found.withColumnRenamed("first", "group"), "group", F.col("second"))
    out = materialise(split(once, "group", F.xxhash64("node")).select("node", "rep", "n", "group"), "groups")
    discard(found)
    return out


def grouped_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Opens every group in one task: rows (group, node, n, leader, tokens), a set each, and a row with a null node for each group, with the union of its tokens and n their number.

    leader is the least node that a set is linked to within its group, directly or by way of others.
    """

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in parts:
            for piece in slices(part, 2):
                groups, nodes, tokens = [], [], []
                for g, node, t in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    s = shingle_set(t, known)
                    if set_id(s) == node:  # a repeated doc_id can have another text too
                        groups.append(g)
                        nodes.append(node)
                        tokens.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], names=["group", "node", "tokens"])

    def open_(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(group: int, nodes: list[int], lists: list[bytes]) -> pa.RecordBatch:
            sets = [_tokens(x) for x in lists]
            leaders = np.asarray(nodes, dtype=np.int64)[Stars(sets, PERCENT).leaders()]
            union = np.unique(np.concatenate(sets)) if len(sets) > 1 else sets[0]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([group] * (len(nodes) + 1), pa.int64()),
                    pa.array([*nodes, None], pa.int64()),
                    pa.array([*map(len, sets), len(union)], pa.int64()),
                    pa.array([*leaders.tolist(), None], pa.int64()),
                    pa.array([*lists, union.tobytes()], pa.binary()),
                ],
                names=["group", "node", "n", "leader", "tokens"],
            )

        now, nodes, lists = None, [], []
        for part in parts:
            for piece in slices(part, 2):
                for g, node, values in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    if g != now:
                        if nodes:
                            yield closed(now, nodes, lists)
                        now, nodes, lists = g, [], []
                    if not nodes or node != nodes[-1]:
                        nodes.append(node)
                        lists.append(values)
        if nodes:
            yield closed(now, nodes, lists)

    # The list of candidates grows with the corpus, so this is a merge join at every size.
    texts = docs.select(F.col("doc_id").alias("rep"), F.col("text").cast("string").alias("text")).join(wanted.select("rep", "node", "group").hint("merge"), "rep")
    sets = texts.select("group", "node", "text").mapInArrow(parse, "group bigint, node bigint, tokens binary")
    dealt = sets.repartition(partitions(docs.sparkSession), "group").sortWithinPartitions("group", "node")
    return materialise(dealt.mapInArrow(open_, "group bigint, node bigint, n bigint, leader bigint, tokens binary"), "grouped-sets")


def asking(grouped: DataFrame, cross: DataFrame) -> DataFrame:
    """group, node, n, token: of the sets that may link to another group, their prefixes less the tokens that no other group has.

    cross: token, key (group), many. A set stays if the tokens that other groups have too suffice for a link; of its
    prefix(n) tokens those of the fewest groups come first.
    """

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, many = None, np.empty(0, np.int64), np.empty(0, np.int32)
        for part in parts:
            for piece in slices(part, 3):
                rows: list[tuple[int, int, int, np.ndarray]] = []
                for g, node, n, values, counts in zip(*(piece.column(i).to_pylist() for i in range(5)), strict=True):
                    if node is None:
                        if g != now:
                            now, tokens, many = g, np.empty(0, np.int64), np.empty(0, np.int32)
                        tokens, many = np.concatenate([tokens, _tokens(values)]), np.concatenate([many, np.frombuffer(counts, dtype=np.int32)])
                        order = np.argsort(tokens)
                        tokens, many = tokens[order], many[order]
                        continue
                    if g != now:
                        continue
                    own = _tokens(values)
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    hit = tokens[at] == own
                    outside = n - int(hit.sum())
                    if n - outside >= needed(n) and (left := prefix(n) - outside) > 0:
                        order = np.argsort(many[at[hit]], kind="stable")[:left]
                        rows.append((g, node, n, own[hit][order]))
                if rows:
                    sizes = [len(r[3]) for r in rows]
                    columns = [pa.array(np.repeat(np.array([r[i] for r in rows], dtype=np.int64), sizes)) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([r[3] for r in rows]))], names=["group", "node", "n", "token"])

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            group, token, many = _numbers(part, 0), _numbers(part, 1), _numbers(part, 2)
            starts, lengths = _runs(group)
            ends = starts + lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group[starts]),
                    pa.array([token[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([many[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ],
                names=["group", "tokens", "counts"],
            )

    spark = grouped.sparkSession
    by_group = cross.select(F.col("key").alias("group"), "token", "many").repartition(partitions(spark), "group").sortWithinPartitions("group")
    known = by_group.mapInArrow(packed, "group bigint, tokens binary, counts binary")
    sets = grouped.where("node is not null").select("group", "node", "n", "tokens", F.lit(None).cast("binary").alias("counts"))
    both = sets.unionByName(known.select("group", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("n"), "tokens", "counts"))
    dealt = both.repartition(partitions(spark), "group").sortWithinPartitions("group", F.asc_nulls_first("node"))
    return dealt.mapInArrow(pick, "group bigint, node bigint, n bigint, token bigint")


def qualifying(asked: DataFrame, cross: DataFrame, unions: DataFrame) -> DataFrame:
    """node, n, other: the groups that have enough of a set's prefix. Of two groups, the sets of the one with fewer tokens ask."""
    sizes = unions.select("group", F.struct(F.col("n").alias("size"), "group").alias("rank"))
    ours = asked.join(sizes, "group").withColumnRenamed("rank", "own_rank")
    matrix = cross.select("token", F.col("key").alias("group")).join(sizes, "group").select("token", F.col("group").alias("other"), "rank")
    met = ours.join(matrix, "token").where("own_rank < rank")
    outside = F.first("n").alias("n")
    near = met.groupBy("node", "other").agg(F.count(F.lit(1)).alias("k"), outside).where(F.col("k") >= 1 + F.floor(F.col("n") / EXTRA))
    return near.select("node", "other")


#: Tokens of asking sets that one task takes on for a group; beyond, the group is opened by several tasks.
ASKED_TOKENS = 4_000_000


def links_between(grouped: DataFrame, near: DataFrame) -> DataFrame:
    """a, b (leaders) that link: each qualifying group's members become a small inverted index, and every asking set is counted against it, if it has enough of the group's union."""

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, index, leaders = None, [], None, np.empty(0, np.int64)
        for part in parts:
            for piece in slices(part, 4):
                a, b = [], []
                for g, salt, asks, leader, values in zip(*(piece.column(i).to_pylist() for i in range(5)), strict=True):
                    if (g, salt) != now:
                        now, members, index, leaders = (g, salt), [], None, []
                    if not asks:
                        members.append(_tokens(values))
                        leaders.append(leader)
                        continue
                    if index is None:
                        index, of = SetIndex(members, PERCENT), np.asarray(leaders, dtype=np.int64)
                    for other in np.unique(of[index.partners(_tokens(values))]).tolist():
                        a.append(leader)
                        b.append(other)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    spark = grouped.sparkSession
    sets = grouped.where("node is not null")
    asks = sets.join(near, "node").select(F.col("other").alias("group"), "node", "n", "leader", "tokens")
    load = near.join(sets.select("node", "n"), "node").groupBy(F.col("other").alias("group")).agg(F.ceil(F.sum("n") / ASKED_TOKENS).cast("int").alias("salts"))
    load = materialise(load, "group-load")
    asks = asks.join(load, "group").select("group", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("asks"), "leader", "tokens")
    members = sets.join(load, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("asks"), "leader", "tokens")
    dealt = members.unionByName(asks).repartition(partitions(spark), "group", "salt").sortWithinPartitions("group", "salt", "asks")
    out = materialise(dealt.mapInArrow(ask, "a bigint, b bigint").where("a <> b").distinct(), "group-links")
    discard(load)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for all nodes of links (a, b): every node takes the smallest label around it, then its label's label, until nothing moves."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    label = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        old = label
        around = both.join(old.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = old.join(around.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = old.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        label = materialise(step.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was"), "labels")
        moved = label.where("comp <> was").limit(1).count()
        discard(old)
        label = label.select("node", "comp")
        if not moved:
            discard(both)
            return label


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles, component_id for every row of docs (doc_id, text).

    Token-group matrix: similar sets form groups of bounded size; each group stores the union of its tokens; a set's
    overlap with a group's union bounds its overlap with every member, first over the rarest tokens of its prefix, then
    over the whole set; groups that qualify are opened, and the set is compared with their members. Within a group
    all sets are compared. So no link is lost, whatever the groups are.

    component_id is the smallest doc_id among the documents reachable by links. Equal sets are one node from the start,
    so copies are never compared. Documents without words (null, empty or blank texts) have no shingles and are their
    own component; a null doc_id counts in no minimum, gets the component of an equal set and otherwise null; repeated
    rows repeat their result; very long texts are sets like others, in groups of their own where they are too large to
    share one; an empty table gives an empty result; other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parsed = materialise(heads(docs), "heads")
    wanted = candidates(parsed)
    rows = materialise(parsed.select("doc_id", "node", "n"), "shingle-sets")
    discard(parsed)
    grouped = grouped_sets(docs, wanted)
    unions = grouped.where("node is null")
    cross = materialise(met_tokens(unions, "group", "tokens"), "cross-tokens")
    asked = materialise(asking(grouped, cross), "asking")
    near = materialise(qualifying(asked, cross, unions), "near-groups")
    for t in (asked, cross):
        discard(t)
    links = links_between(grouped, near)
    comps = components(links)
    led = grouped.where("node is not null").select("node", "leader")
    led = led.join(comps.select(F.col("node").alias("leader"), "comp"), "leader", "left").select("node", F.coalesce("comp", "leader").alias("comp"))
    # Only nodes that share a component with another need its least doc_id; the others have their own.
    members = led.join(wanted.select("node", "rep"), "node")
    lowest = members.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1")
    linked = materialise(members.join(lowest, "comp").select("node", "component_id"), "linked")
    for t in (wanted, grouped, near, links, comps):
        discard(t)
    own = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")).join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    # Written first, so that the join below is between two plain shuffles and a node of very many copies can be split.
    own = materialise(own, "set-components")
    discard(linked)
    found = rows.where("n > 0").join(own.hint("merge"), "node").select("doc_id", "node", F.col("n").alias("n_shingles"), "component_id")
    lone = rows.where("n = 0").select("doc_id", "node", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(lone)


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """Contract of the near-duplicate query: doc_id, n_shingles, component_id; edge cases as in near_duplicates()."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, one of its rows where the id repeats.

    Rows without words, or with a null doc_id, all stay; an empty table stays empty; all columns come back under their
    names, whatever these are.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    found = near_duplicates(docs.select("doc_id", "text"))
    info = found.where("n_shingles > 0 and component_id is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__doc")).agg(F.min("component_id").alias("__least"), F.count(F.lit(1)).alias("__rows"))
    renamed = docs.select(F.col("doc_id").cast("bigint").alias("__id"), *[F.col(c).alias(n) for c, n in own.items()])
    joined = renamed.join(materialise(info, "kept-of-each"), F.col("__id") == F.col("__doc"), "left").where("__least is null or __least = __id")
    once = joined.where("__rows > 1").dropDuplicates(["__id"])
    kept = joined.where("__rows is null or __rows = 1").unionByName(once)
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
