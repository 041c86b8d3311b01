"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

Every distinct fingerprint is in the tile named by the population counts of its four 16-bit quarters. Fingerprints
that differ in r bits have counts that differ by r at most in sum, so a tile meets only tiles within that distance: the
other tile pairs, some 96 of 100 for radius 3, are skipped. What is left is compared whole by exclusive-or and bit
counts in numpy, so no link is lost. Tiles are cut into blocks, and blocks dealt out in groups, so none is held by one
task. The number of comparisons still grows with the square of the distinct fingerprints.

`near_texts` drops near-duplicates by the similarity of their shingles: wider fingerprints find the pairs in the same
way, in tiles of like sizes, and the shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from tidemark.llm.common import blocked, components, frugal, meetings, pieces, settle, star_links, stored

SEED = 42
#: Fingerprints in a block, and blocks of one tile that meet the same copy of a neighbour.
BLOCK, GROUP = 2048, 64
#: Near-duplicate texts share so much of their distinct shingles of so many words.
WORDS, SHARED, OF = 5, 4, 5
#: Bits of their fingerprints that may differ. At the least similarity 16 to 24 of 128 are expected to, of unrelated
#: texts 64.
REACH = 34
#: Texts, and bytes of shingles, that are verified together.
TEXTS, BYTES = 512, 8_000_000


def fingerprint(text: str | None, k: int = 3) -> int:
    """The fingerprint as an unsigned integer; without words zero."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: only A-Z and ASCII white space
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # very long texts: counted piece by piece
        part = words[at : at + (1 << 16) + k - 1]
        if len(words) < k:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(x, SEED) for x in map(b" ".join, zip(*(part[i:] for i in range(k))))]
        h = np.array(hashes, "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", k: int = 3, out: str = "fp") -> DataFrame:
    """docs without `text`, with the fingerprint as a signed long (null text: that of the empty text)."""
    from pyspark.sql.types import LongType, StructField, StructType

    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    schema = StructType([*keep, StructField(out, LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in pieces(batches, text, 4_000_000):
            fp = np.array([fingerprint(t, k) for t in b.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(fp)], names=[f.name for f in keep] + [out])

    return docs.select(*(f.name for f in keep), text).mapInArrow(frugal(run), schema)


def _quarters(fp: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, s).bitwiseAND(F.lit(0xFFFF))) for s in (48, 32, 16, 0)]


def _near(radius: int) -> list[tuple[int, ...]]:
    """Steps between tiles within the radius, each pair of tiles from one side only."""
    span = range(-radius, radius + 1)
    steps = [(a, b, c, d) for a in span for b in span for c in span for d in span if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    return [s for s in steps if s >= (0, 0, 0, 0)]


def tile_pairs(rows: DataFrame, tile: list[str], steps: list[tuple[int, ...]], payload: Column, by: str) -> DataFrame:
    """(left, right, same): the pairs of blocks in tiles that are one of `steps` apart, each once.

    rows has the whole numbers `tile`, the columns of payload and `by`, which deals a tile's rows out to its blocks.
    Tiles are bounded by what their numbers count, so their table can be broadcast whatever the input is.
    """
    tiles = F.broadcast(rows.groupBy(*tile).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    blocks = settle(rows.join(tiles, tile).withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).groupBy(*tile, "block").agg(F.collect_list(payload).alias("held")))
    moves = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(tile, s, strict=True))) for s in steps))
    sent = (
        blocks.select(F.col("block").alias("own"), F.col("held").alias("left"), *(F.col(n).alias(f"own_{n}") for n in tile), F.explode(moves).alias("s"))
        .select("own", "left", F.expr(" + ".join(f"abs(s.{n})" for n in tile)).alias("far"), *((F.col(f"own_{n}") + F.col(f"s.{n}")).alias(n) for n in tile))
        .join(tiles, tile)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"cast((blocks - 1) div {GROUP} as int)"))))
    )
    pairs = sent.join(blocks.withColumn("part", F.expr(f"cast(block div {GROUP} as int)")), [*tile, "part"]).filter("far > 0 or own <= block")
    return pairs.select("left", F.col("held").alias("right"), F.expr("far = 0 and own = block").alias("same"))


def links(distinct: DataFrame, fp: str = "fp", radius: int = 3) -> DataFrame:
    """(u, v): for each pair of blocks a spanning star of the fingerprints at `radius` or fewer differing bits.

    The stars join exactly what the links join. distinct holds each fingerprint once; it is read twice.
    """
    q = [f"q{i}" for i in range(4)]  # at most 17^4 = 83,521 tiles
    rows = distinct.filter(F.col(fp).isNotNull()).select(F.col(fp).alias("fp"), *(c.alias(n) for n, c in zip(q, _quarters(fp), strict=True)))
    pairs = tile_pairs(rows, q, _near(radius), F.col("fp"), "fp").select("left", "right")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found: list = []
            for a, c in zip(b.column("left"), b.column("right"), strict=True):
                x, y = (np.asarray(z.values).view(np.uint64) for z in (a, c))
                i, j = [], []
                for at in range(0, len(x), 128):  # 128 by 2048 words of 8 bytes stay in the cache
                    hit = np.nonzero(np.bitwise_count(x[at : at + 128, None] ^ y[None, :]) <= radius)
                    i.append(hit[0] + at)
                    j.append(hit[1])
                i, j = np.concatenate(i), np.concatenate(j)
                if (other := x[i] != y[j]).any():
                    both, at = np.unique(np.concatenate([x, y]), return_inverse=True)  # a block may meet itself
                    u, v = star_links(at[: len(x)][i[other]], at[len(x) :][j[other]], len(both))
                    found.append(np.stack([both[u], both[v]]).view(np.int64))
            uv = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], names=["u", "v"])

    return pairs.mapInArrow(frugal(compare), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lower-case hex digits), component_id.

    Fingerprints link at `radius` or fewer differing bits, and component_id is the smallest id that links reach from
    the row, its own included. Defined cases: a null text is the empty text, whose fingerprint is zero and links like
    any other. A row without id keeps its fingerprint, names no component and gets the smallest id of the one its
    fingerprint is in (null if there is none). Repeated rows and repeated ids stand each by their own fingerprint.
    Other columns are ignored; an empty table gives no rows. Texts may have any length.
    """
    # Written once: the texts are read and hashed a single time, and what follows moves 16 bytes a document.
    prints = settle(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", k))
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct, "fp", radius))
    # Only linked fingerprints meet by their component, first in each task, so a large component isn't gathered.
    linked = settle(distinct.join(roots, distinct.fp == roots.node).select("fp", "least", "root"))
    gathered = linked.groupBy("root").agg(F.min("least").alias("all_least"))
    found = linked.join(gathered, "root").select("fp", "all_least")
    # Settled, so that the last join reads both sides from plain exchanges, whose large partitions Spark can split.
    classes = settle(distinct.join(found, "fp", "left").select("fp", F.coalesce("all_least", "least").alias("component_id")))
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, k: int = WORDS):
    """Sorted distinct 64-bit hashes of the shingles of k words (fewer words: of the whole sequence; none: no hash)."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n, digest, parts = max(1, len(words) - k + 1), xxhash.xxh3_64_intdigest, []
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + k - 1]
        rows = map(b" ".join, zip(*(part[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
        parts.append(np.unique(np.fromiter(map(digest, rows), np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def wide_print(hashes) -> tuple[int, int]:
    """128 bits as two signed integers: each is set where it is in over half of the hashes, mixed anew for the second."""
    import numpy as np

    out = []
    for turn in range(2):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            h = hashes[at : at + (1 << 16)]
            if turn:  # a full mix of all bits, so the second word says something of its own
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                h = h ^ (h >> np.uint64(32))
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def wide_prints(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """cls, n (distinct shingles), a and b (the fingerprint's halves) of texts (cls, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches, "text", 4_000_000):
            rows = []
            for t in batch.column("text").to_pylist():
                hashes = shingle_hashes(t, k)
                rows.append((len(hashes), *wide_print(hashes)))
            rows = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3))], names=["cls", "n", "a", "b"])

    return texts.select("cls", "text").mapInArrow(frugal(run), "cls long, n long, a long, b long")


def _size_tiles(prints: DataFrame, shared: int, of: int, reach: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """prints with the tile numbers `s` and `p`, and the steps between tiles that can hold similar texts.

    Sets that share `shared` of `of` have sizes within that ratio of each other, and fingerprints within reach have
    population counts within it; all other pairs of tiles are skipped. A tile spans half the ratio, or the reach.
    """
    step = F.log(F.lit(of / shared)) / 2
    size = F.when(F.col("n") > 0, F.floor(F.log("n") / step)).otherwise(-9)  # what has no words meets its like alone
    bits = F.floor((F.bit_count("a") + F.bit_count("b")) / (reach + 1))
    steps = [(s, p) for s in range(3) for p in (-1, 0, 1) if (s, p) >= (0, 0)]
    return prints.select("*", size.cast("int").alias("s"), bits.cast("int").alias("p")), steps


def candidates(prints: DataFrame, shared: int = SHARED, of: int = OF, reach: int = REACH) -> DataFrame:
    """(u, v): for each pair of blocks a spanning star of the texts whose fingerprints differ by `reach` bits or fewer,
    from prints (cls, n, a, b). What is near is among what the stars join."""
    rows, steps = _size_tiles(prints, shared, of, reach)
    pairs = tile_pairs(rows, ["s", "p"], steps, F.struct("cls", "n", "a", "b"), "cls")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = []
            for left, right, same in zip(*(batch.column(c) for c in ("left", "right", "same")), strict=True):
                x = _loaded(left.values)
                y = x if same.as_py() else _loaded(right.values)
                i, j = _close(x, y, shared, of, reach)
                if same.as_py():
                    i, j = i[i < j], j[i < j]
                if len(i):
                    ids, at = np.unique(np.concatenate([x["cls"], y["cls"]]), return_inverse=True)
                    place, root = star_links(at[: len(x["cls"])][i], at[len(x["cls"]) :][j], len(ids))
                    found.append(np.stack([ids[place], ids[root]]))
            if found:
                uv = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], names=["u", "v"])

    return pairs.mapInArrow(frugal(compare), "u long, v long")


def _loaded(held) -> dict:
    import numpy as np

    return {f: np.asarray(held.field(f)).view(np.uint64 if f in "ab" else np.int64) for f in ("cls", "n", "a", "b")}


def _close(x: dict, y: dict, shared: int, of: int, reach: int):
    """Places (i, j) of the texts of two blocks whose fingerprints and sizes are within reach."""
    import numpy as np

    found = []
    for at in range(0, len(x["cls"]), 128):
        part = slice(at, at + 128)
        far = np.bitwise_count(x["a"][part, None] ^ y["a"][None, :])
        far += np.bitwise_count(x["b"][part, None] ^ y["b"][None, :])
        i, j = np.nonzero(far <= reach)
        n, m = x["n"][part][i], y["n"][j]
        fit = (of * n >= shared * m) & (of * m >= shared * n)
        found.append((i[fit] + at, j[fit]))
    return (np.concatenate(z) for z in zip(*found, strict=True))


def similar(x: list, y: list, i, j, n: int, shared: int, of: int):
    """Roots of n texts, x and then y, that the similar ones of the pairs (x[i], y[j]) join; x and y are hashes.

    Shingles that two texts have are bits of their rows, so what a text shares with many is counted at once; pairs that
    are joined already aren't looked at.
    """
    import numpy as np

    sets = x if y is x else [*x, *y]
    offset = 0 if y is x else len(x)
    size = np.array([len(s) for s in sets])
    hashes, code, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    keep = count[code] > 1
    owner, code = owner[keep], number[code[keep]]
    rows = np.zeros((len(sets), int((count > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(rows, (owner, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    root = np.arange(n)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order] + offset
    cut = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
    for first, stop in zip(cut[:-1], cut[1:], strict=True):
        one, others = i[first], j[first:stop]
        others = others[root[others] != root[one]]
        for at in range(0, len(others), 64):
            some = others[at : at + 64]
            both = np.bitwise_count(rows[one] & rows[some]).sum(1, dtype=np.int64)
            near = some[of * both >= shared * (size[one] + size[some] - both)]
            if len(near):
                joined = np.append(root[near], root[one])
                root[np.isin(root, joined)] = joined.min()
    return root


def verified(groups: DataFrame, prints: DataFrame, texts: DataFrame, k: int = WORDS, shared: int = SHARED, of: int = OF, reach: int = REACH) -> DataFrame:
    """(u, v): spanning stars of the texts that share `shared` of `of` of their distinct shingles, or have none.

    groups (node, root) says which texts may be near. Each sends its shingles once to its group, whose blocks meet two
    at a time; pairs within reach are verified there, so no pair is ever a row.
    """

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, "text", 4_000_000):
            found = [shingle_hashes(t, k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(found, pa.binary())], names=["cls", "shingles"])

    members = groups.withColumnRenamed("node", "cls")
    sets = texts.join(members, "cls", "left_semi").select("cls", "text").mapInArrow(frugal(hashed), "cls long, shingles binary")
    rows = members.join(prints, "cls").join(sets, "cls")
    count = F.greatest(F.ceil(F.count("*") / TEXTS), F.ceil(F.sum(F.octet_length("shingles").cast("long")) / BYTES))
    blocks = stored(blocked(stored(rows, "members"), ["root"], count, "cls", "n", "a", "b", "shingles"), "near")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            u, v = [], []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x = _loaded(left.values)
                own = [np.frombuffer(z.as_buffer(), np.uint64) for z in left.values.field("shingles")]
                if right.is_valid:
                    y, other = _loaded(right.values), [np.frombuffer(z.as_buffer(), np.uint64) for z in right.values.field("shingles")]
                    i, j = _close(x, y, shared, of, reach)
                    cls = np.concatenate([x["cls"], y["cls"]])
                else:
                    i, j = _close(x, x, shared, of, reach)
                    i, j, other, cls = i[i < j], j[i < j], own, x["cls"]
                if not len(i):
                    continue
                root = similar(own, other, i, j, len(cls), shared, of)
                place = np.flatnonzero(root != np.arange(len(cls)))
                u.append(cls[place])
                v.append(cls[root[place]])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    alone = blocks.select(F.col("held").alias("left"), F.lit(None).cast(blocks.schema["held"].dataType).alias("right"))
    found = [w.select("left", "right").mapInArrow(frugal(compare), "u long, v long") for w in (alone, meetings(blocks, ["root"]))]
    return found[0].unionByName(found[1])


def near_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS, shared: int = SHARED, of: int = OF, reach: int = REACH) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id stays, null ids last.

    Two texts are near if they share `shared` of `of` of their distinct shingles of k words, lower-cased; links of
    links are one group. Fingerprints of 128 bits, compared exactly in tiles, propose pairs, and the shingles decide;
    a pair within the similarity is proposed but for the rare one whose fingerprints differ by more than `reach`.
    Equal texts become one class before anything is compared. What hangs together by candidates is verified together,
    in blocks that give spanning stars, so pairs are never listed.

    Defined cases: texts without words (null ones, too) are one group; rows without id are rows like any others;
    rows that share an id are told apart by their text; of rows with equal id and text the one with the smallest hash
    of its columns stays. Columns may have any names; an empty table gives no rows; texts may have any length.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)]
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*hashable))
    key = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    # Each task keeps one row of a text, so copies don't meet before they are one.
    reps = docs.select(key.alias("key"), F.struct(*columns).alias("row"), order.alias("order")).groupBy("key").agg(F.min_by("row", "order").alias("row"))
    reps = stored(reps.withColumn("cls", F.monotonically_increasing_id()), "texts")
    texts = reps.select("cls", F.coalesce(F.col("row").getField(text), F.lit("")).alias("text"))
    prints = settle(wide_prints(texts, k))
    groups = stored(components(candidates(prints, shared, of, reach)), "candidates")
    roots = components(verified(groups, prints, texts, k, shared, of, reach))
    member = reps.select("cls", F.struct(F.col("row").getField(id_col).isNull().alias("lost"), F.col("row").getField(id_col).alias("id"), "key", "cls").alias("order"))
    grouped = member.join(roots, member.cls == roots.node).select("cls", "root", "order")
    first = grouped.groupBy("root").agg(F.min("order")["cls"].alias("first"))
    gone = stored(grouped.join(first, "root").filter("cls <> first").select("cls"), "gone")
    return reps.join(gone, "cls", "left_anti").select("row.*")


def _has_map(kind) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (MapType, VariantType)) or isinstance(kind, ArrayType) and _has_map(kind.elementType)
