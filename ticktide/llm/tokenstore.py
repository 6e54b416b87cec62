"""A content-addressed store of token ids.

Each document's ids, with the end id, are cut where a hash rolling over eight ids says so, so equal passages give equal chunks
wherever they stand. The store keeps each distinct chunk once, under its digest. A document's recipe lists its chunks' digests
and lengths; the root of a Merkle tree over them is its address. Recipes are written in ascending doc_id order, in parts. The
manifest has for each part the root over its documents' addresses, ids and lengths, and how many documents and ids it has; its
top has the root over all parts and their sums.

Files, all Parquet:  staged/kind=0 (key, body: a chunk's little-endian ids), recipes (a row per document), manifest, top.
Reading checks the manifest against its top, each part's recipes against the manifest (none lost, doubled, swapped or altered),
every recipe against its address and every chunk against its digest and length; what doesn't agree raises an error.

Null text: empty, the end id alone. Texts of any length are cut alike. Repeated doc_ids: each row is a document, in the order of
their recipes; rows without a doc_id come first. An empty table makes a store without documents. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.llm import common, tokens

ROLL, LONGEST, DIGEST = 8, 1024, 16
MEAN_BITS = 8  # a chunk ends after one id in 2**8, about
_STAGED = "kind int, key binary, doc_id long, n_tokens long, body binary"
_RECIPES = "part int, kind int, nth long, doc_id long, start long, n_tokens long, root binary, recipe binary"
_PARTS = "part int, n_documents long, n_tokens long, root binary"
_TOP = "n_parts int, n_documents long, n_tokens long, root binary"
#: Distinct pre-tokens that a worker remembers, and bytes of text that it encodes at once.
CACHE, AT_ONCE = tokens.CACHE, 3 << 20
#: Digests that a task remembers, so as to send a chunk once.
SEEN = 500_000
_REFS = "part int, nth long, doc_id long, start long, n_tokens long, digest binary, n long, ids_after long"


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; a node without a partner goes up as it is."""
    while len(leaves) > 1:
        paired = [digest(b"\1" + leaves[i] + leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = paired + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0] if leaves else digest(b"")


class GrowingRoot:
    """A Merkle root over leaves that come one by one; keeps one node a level."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.stack and self.stack[-1][0] == level:
            leaf, level = digest(b"\1" + self.stack.pop()[1] + leaf), level + 1
        self.stack.append((level, leaf))

    def root(self) -> bytes:
        nodes = [x for _, x in self.stack]
        while len(nodes) > 1:
            nodes[-2:] = [digest(b"\1" + nodes[-2] + nodes[-1])]
        return nodes[0] if nodes else digest(b"")


def chunk_ends(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ascending ends of the chunks of documents that begin at `at` (with the end of all). No chunk crosses a document."""
    n = np.diff(at)
    place = np.arange(len(ids)) - np.repeat(at[:-1], n)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled, factor = mixed.copy(), 1
    for k in range(1, ROLL):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        rolled[k:] += np.where(place[k:] >= k, mixed[:-k] * np.uint64(factor), np.uint64(0)) if len(ids) > k else np.uint64(0)
    cut = (rolled >> np.uint64(40)) & np.uint64((1 << MEAN_BITS) - 1) == 0
    cut[at[1:] - 1] = True  # every document has an id at least
    ends = np.flatnonzero(cut) + 1
    gaps = np.diff(ends, prepend=0)
    parts = -(-gaps // LONGEST)
    if parts.max(initial=1) > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.minimum(np.repeat(ends - gaps, parts) + (nth + 1) * LONGEST, np.repeat(ends, parts))
    return ends


def _staged(docs: DataFrame, tokenizer_path: str, end_id: int, width: str) -> DataFrame:
    """Chunks, each once a task, and documents with their recipes, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = tokens.coder(tokenizer_path, CACHE), set()
        for batch in batches:
            for part in tokens.slices(batch, "text", size=AT_ONCE):
                ids, at = code.encode(part.column("text"))
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                ends = chunk_ends(ids, at)
                sizes = np.diff(ends, prepend=0)
                body = memoryview(ids.astype(width)).cast("B")
                w = np.dtype(width).itemsize
                keys, bodies, digests = [], [], []
                for b, n in zip((ends * w).tolist(), (sizes * w).tolist()):
                    chunk = bytes(body[b - n : b])
                    digests.append(key := digest(chunk))
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        bodies.append(chunk)
                if len(seen) > SEEN:
                    seen.clear()
                entries = np.empty((len(ends), DIGEST + 4), np.uint8)
                entries[:, :DIGEST] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)
                entries[:, DIGEST:] = sizes.astype("<u4").view(np.uint8).reshape(-1, 4)
                of = np.searchsorted(ends, at, side="right")  # chunks that end at or before a document's start
                recipes = [entries[a:b].tobytes() for a, b in zip(of[:-1].tolist(), of[1:].tolist())]
                doc_ids = part.column("doc_id").to_pylist()
                spread = [digest(repr((d, i)).encode()) for i, d in enumerate(doc_ids)]
                k = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * k + [1] * len(recipes), pa.int32()),
                        pa.array(keys + spread, pa.binary()),
                        pa.array([None] * k + doc_ids, pa.int64()),
                        pa.array([None] * k + np.diff(at).tolist(), pa.int64()),
                        pa.array(bodies + recipes, pa.binary()),
                    ],
                    ["kind", "key", "doc_id", "n_tokens", "body"],
                )
        batch = part = seen = None
        common.trim()  # the worker waits for its next task with the coder's cache alone

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _STAGED)


def _fixed(keys: pa.Array) -> np.ndarray:
    """Digests as rows of bytes."""
    return np.frombuffer(keys.buffers()[2], np.uint8)[keys.offset * DIGEST : (keys.offset + len(keys)) * DIGEST].reshape(-1, DIGEST) if len(keys) else np.zeros((0, DIGEST), np.uint8)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the chunks of a partition, which has all of a digest's, in order, the first of each digest; all documents."""
    tokens.release()
    common.trim()
    last = np.zeros((0, DIGEST), np.uint8)
    for batch in batches:
        keys = _fixed(batch.column("key"))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        if len(last) and len(keys):
            fresh[0] = (keys[0] != last[0]).any()
        last = keys[-1:].copy() if len(keys) else last
        yield batch.filter(pa.array(fresh | (batch.column("kind").to_numpy() == 1)))


def part_leaf(doc_id: int | None, n_tokens: int, root: bytes) -> bytes:
    return digest(f"{doc_id} {n_tokens} ".encode() + root)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of a sorted partition with their place, then the row that ends the part."""
    from pyspark import TaskContext

    part, nth, start, whole = TaskContext.get().partitionId(), 0, 0, GrowingRoot()
    names = ["part", "kind", "nth", "doc_id", "start", "n_tokens", "root", "recipe"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    rows = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    for batch in batches:
        recipes, n, ids = batch.column("body").to_pylist(), batch.column("n_tokens").to_numpy(), batch.column("doc_id").to_pylist()
        roots = [merkle_root(leaves(r)) for r in recipes]
        for x in zip(ids, n.tolist(), roots):
            whole.add(part_leaf(*x))
        starts = start + np.cumsum(n) - n
        yield rows([part] * len(n), [0] * len(n), np.arange(nth, nth + len(n)), ids, starts, n, roots, recipes)
        nth, start = nth + len(n), start + int(n.sum())
    yield rows([part], [1], [nth], [None], [start], [start], [whole.root()], [b""])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The manifest's rows anew from recipes in the order of part and nth; a gap or a double raises an error."""
    part, nth, start, whole = None, 0, 0, GrowingRoot()
    row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int64()), pa.array([start], pa.int64()), pa.array([whole.root()], pa.binary())], ["part", "n_documents", "n_tokens", "root"])
    for batch in batches:
        for own, at, doc_id, begin, n, root in zip(*(c.to_pylist() for c in batch.columns)):
            if own != part:
                if part is not None:
                    yield row()
                part, nth, start, whole = own, 0, 0, GrowingRoot()
            if (at, begin) != (nth, start):
                raise ValueError(f"recipes of part {own} aren't gapless at document {nth}")
            whole.add(part_leaf(doc_id, n, root))
            nth, start = nth + 1, start + n
    if part is not None:
        yield row()


def leaves(recipe: bytes) -> list[bytes]:
    return [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST + 4)]


class TokenStore:
    """A store in a folder: write() fills it, the other methods read its files."""

    def __init__(self, spark: SparkSession, folder: str, width: str = "<u2"):
        self.spark, self.folder, self.width = spark, folder, width

    @classmethod
    def write(cls, docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> TokenStore:
        spark = docs.sparkSession
        width = "<u2" if max(tokens.coder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        n = common.shuffle_partitions(spark)
        dealt = _staged(docs, tokenizer_path, end_id, width).repartition(n, "key").sortWithinPartitions("kind", "key").mapInArrow(_once, _STAGED)
        dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/staged")
        made = cls(spark, folder, width)
        recipes = made._files("staged", _STAGED.removeprefix("kind int, ") + ", kind int").where("kind = 1").select("doc_id", "n_tokens", "key", "body")
        ranged = recipes.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key").mapInArrow(_in_order, _RECIPES)
        ranged.write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/recipes")
        common.remove(spark, f"{folder}/staged/kind=1")
        made._recipes(1).select("part", F.col("nth").alias("n_documents"), "n_tokens", "root").coalesce(1).write.parquet(f"{folder}/manifest")
        parts = made.manifest().orderBy("part").collect()  # as many as shuffle partitions
        top = (len(parts), sum(p.n_documents for p in parts), sum(p.n_tokens for p in parts), merkle_root([bytes(p.root) for p in parts]))
        spark.createDataFrame([top], _TOP).coalesce(1).write.parquet(f"{folder}/top")
        return made

    def _files(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def manifest(self) -> DataFrame:
        """A row per part: how many documents and ids it has, and the root over its documents."""
        return self._files("manifest", _PARTS)

    def _recipes(self, kind: int = 0) -> DataFrame:
        return self._files("recipes", _RECIPES.replace("kind int, ", "") + ", kind int").where(F.col("kind") == kind)

    def checked(self) -> list:
        """The manifest's rows by part, once the top, and the recipes by part, agree with them."""
        tops, parts = self._files("top", _TOP).collect(), self.manifest().orderBy("part").collect()
        said = (len(parts), sum(p.n_documents for p in parts), sum(p.n_tokens for p in parts), merkle_root([bytes(p.root) for p in parts]))
        if [tuple(t) for t in tops] != [said] or [p.part for p in parts] != list(range(len(parts))):
            raise ValueError("the manifest doesn't agree with its top")
        dealt = self._recipes().select("part", "nth", "doc_id", "start", "n_tokens", "root").repartition(common.shuffle_partitions(self.spark), "part")
        found = dealt.sortWithinPartitions("part", "nth").mapInArrow(_rebuilt, _PARTS).collect()
        if sorted(map(tuple, found)) != [tuple(p) for p in parts if p.n_documents]:
            raise ValueError("recipes don't agree with the manifest")
        return parts

    def documents(self) -> DataFrame:
        """part, nth, doc_id, start among all ids, n_tokens, root, recipe: a row per document."""
        rows, base = [], 0
        for p in self.checked():
            rows.append((p.part, base))
            base += p.n_tokens
        bases = self.spark.createDataFrame(rows, "part int, base long")
        return self._recipes().join(F.broadcast(bases), "part").select("part", "nth", "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "root", "recipe")

    def references(self) -> DataFrame:
        """A row per chunk of each document, with how many ids follow it there; recipes are checked against their roots."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens.release()
            names = ["part", "nth", "doc_id", "start", "n_tokens"]
            for batch in batches:
                recipes = batch.column("recipe").to_pylist()
                counts = np.array([len(r) // (DIGEST + 4) for r in recipes], np.int64)
                for recipe, root in zip(recipes, batch.column("root").to_pylist()):
                    if merkle_root(leaves(recipe)) != root:
                        raise ValueError("a recipe doesn't match its root")
                entries = np.frombuffer(b"".join(recipes), np.uint8).reshape(-1, DIGEST + 4)
                sizes = entries[:, DIGEST:].copy().view("<u4").ravel().astype(np.int64)
                upto = np.cumsum(sizes)
                of = np.repeat(np.arange(len(counts)), counts)
                ends = upto[np.cumsum(counts) - 1]
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(entries), [None, pa.py_buffer(entries[:, :DIGEST].tobytes())]).cast(pa.binary())
                taken = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in names), keys, pa.array(sizes), pa.array(ends[of] - upto)], [*names, "digest", "n", "ids_after"])

        return self.documents().select("part", "nth", "doc_id", "start", "n_tokens", "root", "recipe").mapInArrow(run, _REFS)

    def chunks(self) -> DataFrame:
        """key, body as stored; each is checked against its digest where it is read."""
        return self._files("staged", _STAGED.removeprefix("kind int, ") + ", kind int").where("kind = 0").select("key", "body")

    def _sums(self) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, bodies = batch.column("key").to_pylist(), batch.column("body").to_pylist()
                if any(digest(b) != k for k, b in zip(keys, bodies)):
                    raise ValueError("a chunk doesn't match its digest")
                ids = memoryview(np.frombuffer(b"".join(bodies), width).astype("<u4")).cast("B")
                sizes = np.array([len(b) for b in bodies], np.int64) // np.dtype(width).itemsize
                ends = 4 * np.cumsum(sizes)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes), pa.array(crcs, pa.int64())], ["key", "held", "crc"])

        return self.chunks().mapInArrow(run, "key binary, held long, crc long")

    def checksums(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of each document's ids as little-endian 32-bit integers, from the files alone.

        A document's checksum is put together from its chunks': a CRC of a concatenation is the exclusive or of the parts'
        CRCs, each carried over the bytes after it. So each stored chunk is read and summed once, and no ids are shuffled.
        """

        def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["part", "nth", "doc_id", "start", "n_tokens", "held"]
            for batch in batches:
                if (batch.column("n").to_numpy() != batch.column("held").to_numpy()).any():
                    raise ValueError("a chunk hasn't the length that a recipe gives")
                moved = carried(batch.column("crc").to_numpy(), 4 * batch.column("ids_after").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(moved)], [*names, "crc"])

        joined = self.references().join(self._sums(), F.col("digest") == F.col("key"), "left").drop("key", "digest")
        joined = joined.withColumn("held", F.coalesce("held", F.lit(-1))).withColumn("crc", F.coalesce("crc", F.lit(0)))  # a chunk that is missing fails
        moved = joined.mapInArrow(carry, "part int, nth long, doc_id long, start long, n_tokens long, held long, crc long")
        summed = moved.groupBy("part", "nth", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("crc"), F.sum("held").alias("read"))
        crc = F.when(F.col("read") == F.col("n_tokens"), F.col("crc")).otherwise(F.raise_error(F.lit("a document's chunks don't have its number of ids")).cast("long"))
        return summed.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"), "read")

    def read(self, doc_ids: DataFrame | None = None) -> DataFrame:
        """doc_id, start, ids (array of int): documents rebuilt from their recipes; of all, or of those in doc_ids."""
        refs = self.references() if doc_ids is None else self.references().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        width = self.width

        def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = []
                for n_tokens, row in zip(batch.column("n_tokens").to_pylist(), batch.column("bodies").to_pylist()):
                    if any(x["body"] is None or digest(x["body"]) != x["digest"] for x in row):
                        raise ValueError("a chunk is missing or doesn't match its digest")
                    ids.append(np.frombuffer(b"".join(x["body"] for x in row), width).astype(np.int32))
                    if len(ids[-1]) != n_tokens:
                        raise ValueError("a document's chunks don't have its number of ids")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

        met = refs.join(self.chunks(), F.col("digest") == F.col("key"), "left")
        bodies = met.groupBy("part", "nth", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct((-F.col("ids_after")).alias("at"), "digest", "body"))).alias("bodies"))
        return bodies.select("doc_id", "start", "n_tokens", "bodies").mapInArrow(join_up, "doc_id long, start long, ids array<int>")


def _square(m: np.ndarray) -> np.ndarray:
    return _applied(m, m)


def _applied(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The 32 x 32 bit matrix m (its columns as integers) times each of v."""
    out = np.zeros_like(v)
    for bit in range(32):
        out ^= np.where(v >> np.uint64(bit) & np.uint64(1), m[bit], np.uint64(0))
    return out


def carried(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What CRC-32s turn into when n_bytes more bytes follow, before those bytes' own CRC is added."""
    out, left = crcs.astype(np.uint64), n_bytes.astype(np.int64)
    m = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint64)  # one zero bit
    for _ in range(3):
        m = _square(m)
    while left.any():
        odd = left & 1 == 1
        out[odd] = _applied(m, out[odd])
        m, left = _square(m), left >> 1
    return out.astype(np.int64)
