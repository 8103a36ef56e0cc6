"""LM scoring by deleted interpolation of a bigram, a unigram and a uniform model.

p(v | u) = l2 * c(u, v) / c(u) + l1 * c(v) / N + l0 / (V + 1), the maximum-likelihood estimates mixed by weights of the
bucket of the context's frequency, floor(log2(c(u) + 1)). The weights are learned by expectation-maximisation on a
deleted part of the training documents, under counts of the rest; the score uses the counts of all training documents.

Texts are read once into blocks of token numbers, written to the shared folder. A block asks for the counts of its own
distinct words and word pairs: keys dealt into cells of hash space, one entry per key and block, so a frequent word costs
an entry per block. Cells add up in 64 bits and answer in the order of the question; a block sends nothing to a cell it
has no key of, so there are never more rows than keys. Nothing of the vocabulary is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.llm.common import cell_bounds, cells_for, crc_mod, documents, from_planes, joined, planes, query, record, stored
from loomtab.llm.wordblocks import mixed, slices, word_hashes, words_of

TOKENS = 2_000_000
END = np.uint64(0x0E4D0E4D0E4D0E4D)
BLOCKS = "block long, deleted boolean, docs binary, parts binary, lengths binary, words binary, tokens binary"


def read_blocks(rows: DataFrame, deleted: int, tokens: int = TOKENS) -> DataFrame:
    """Documents (doc_id, text, part) as blocks: ids, parts, lengths, sorted word hashes and token numbers.

    Documents of the deleted part have blocks of their own. Every document ends with the end token.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        names = [(n, pa.binary()) for n in ("docs", "parts", "lengths", "words", "tokens")]
        schema = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), *names])
        held: dict[bool, list[tuple]] = {False: [], True: []}

        def flush(which: bool) -> pa.RecordBatch:
            docs, parts, lengths, hashes = (np.concatenate(x) for x in zip(*held[which]))
            held[which].clear()
            words, number = numbered(hashes)
            del hashes
            blob = press(planes(number.astype(np.uint32)))
            return record(
                schema, block=[uuid.uuid4().int >> 66], deleted=[which], docs=[docs.tobytes()], parts=[parts.tobytes()],
                lengths=[lengths.tobytes()], words=[words.tobytes()], tokens=[blob],
            )

        for batch in batches:
            for part_rows, text in slices(batch):
                words = words_of(text)
                hashes = np.insert(word_hashes(text, words), words.first[1:], END)
                length = words.count + 1
                part = part_rows.column("part").to_numpy().astype(np.int64)
                known = part_rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = part_rows.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                part = np.where(known, part, -1)
                for which in (False, True):
                    mine = (part == deleted) == which
                    if mine.any():
                        held[which].append((ids[mine], part[mine], length[mine], hashes[np.repeat(mine, length)]))
                        if sum(len(x[3]) for x in held[which]) >= tokens:
                            yield flush(which)
        for which in (False, True):
            if held[which]:
                yield flush(which)

    return rows.mapInArrow(emit, BLOCKS)


def narrowed(values: np.ndarray) -> bytes:
    """Counts in 4 bytes each where all fit, else in 8; the first byte says which."""
    kind = np.dtype(np.uint32 if values.max(initial=0) < 1 << 32 else np.int64)
    return bytes([kind.itemsize]) + planes(values.astype(kind))


def widened(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    parts = [from_planes(pa.array([x[1:]], pa.binary()), np.uint32 if x[0] == 4 else np.int64) for x in column.to_pylist()]
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and every value's place among them, as ``np.unique`` has them but with half of its memory."""
    order = np.argsort(values, kind="stable")
    fresh = np.ones(len(values), bool)
    ran = values[order]
    fresh[1:] = ran[1:] != ran[:-1]
    distinct = ran[fresh]
    del ran
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return distinct, place


class Block:
    """A block's tokens, its distinct words and word pairs, and the order in which it asks for them."""

    def __init__(self, row: dict):
        import zstandard

        self.docs, self.parts, self.lengths = (np.frombuffer(row[n], np.int64) for n in ("docs", "parts", "lengths"))
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = from_planes(pa.array([zstandard.ZstdDecompressor().decompress(row["tokens"])]), np.uint32).view(np.int32)
        end = np.searchsorted(self.words, END)
        both = np.empty(len(self.tokens), np.int64)
        both[1:] = self.tokens[:-1]  # a document begins after an end
        both[np.cumsum(self.lengths) - self.lengths] = end
        both *= len(self.words)
        both += self.tokens
        self.pairs, self.pair = numbered(both)
        del both
        self.keys = np.empty(len(self.words) + len(self.pairs), np.uint64)
        self.keys[: len(self.words)] = mixed(self.words, 30) & ~np.uint64(1)
        for start in range(0, len(self.pairs), 1 << 16):  # in pieces: the hashing makes several arrays of its input's size
            u, v = np.divmod(self.pairs[start : start + (1 << 16)], len(self.words))
            two = mixed(mixed(self.words[u], 31) + mixed(self.words[v], 32), 33) | np.uint64(1)
            self.keys[len(self.words) + start : len(self.words) + start + len(two)] = two
        self.order = np.argsort(self.keys, kind="stable").astype(np.int32)

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How often each key stands in the documents of the mask, in key order."""
        use = np.repeat(mask, self.lengths)
        one = np.bincount(self.tokens[use], minlength=len(self.words))
        two = np.bincount(self.pair[use], minlength=len(self.pairs))
        return np.concatenate([one, two])[self.order].astype(np.uint32)

    def answered(self, answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and of pairs from the cells' answers."""
        got = np.empty(len(self.keys), np.int64)
        got[self.order] = widened(answers.sort_by("cell")[column])
        return got[: len(self.words)], got[len(self.words) :]


def ask(blocks: DataFrame, held_out: int, cells: int) -> DataFrame:
    """(cell, block, keys, train, kept): the keys of every block with its counts in training and without the deleted part."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("train", pa.binary()), ("gone", pa.binary())])
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(row)
                train = block.counts((block.parts != held_out) & (block.parts >= 0))
                gone = train if row["deleted"] else np.zeros_like(train)
                keys = block.keys[block.order]
                bounds = cell_bounds(keys, cells)
                for c in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
                    cut = slice(bounds[c], bounds[c + 1])
                    yield record(schema, cell=[c], block=[row["block"]], keys=[keys[cut].tobytes()], train=[planes(train[cut])], gone=[planes(gone[cut])])

    return blocks.mapInArrow(emit, "cell int, block long, keys binary, train binary, gone binary")


def answer(asked: DataFrame) -> DataFrame:
    """(block, cell, total, kept, n, kept_n, types): totals in the order asked; sums for N and V stand once per cell."""

    def add(table: pa.Table) -> pa.Table:
        keys = joined(table["keys"], np.uint64)
        train, gone = (from_planes(table[c], np.uint32).astype(np.int64) for c in ("train", "gone"))
        key, back = np.unique(keys, return_inverse=True)
        total, kept = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        np.add.at(total, back, train)
        np.add.at(kept, back, train - gone)
        one = (key & np.uint64(1)) == 0
        ends = np.cumsum([len(x) // 8 for x in table["keys"].to_pylist()])
        cuts = [slice(a, b) for a, b in zip(np.append(0, ends[:-1]), ends)]
        sums = [int(total[one].sum()), int(kept[one].sum()), int((total[one] > 0).sum()), int((kept[one] > 0).sum())]
        once = [[s] + [0] * (len(cuts) - 1) for s in sums]
        return pa.table(
            {
                "block": table["block"], "cell": table["cell"],
                "total": pa.array([narrowed(total[back[c]]) for c in cuts], pa.binary()),
                "kept": pa.array([narrowed(kept[back[c]]) for c in cuts], pa.binary()),
                "n": pa.array(once[0]), "kept_n": pa.array(once[1]), "types": pa.array(once[2]), "kept_types": pa.array(once[3]),
            }
        )

    return asked.groupBy("cell").applyInArrow(add, "block long, cell int, total binary, kept binary, n long, kept_n long, types long, kept_types long")


P2_STEP, P1_STEP, P2_BINS, P1_BINS = 8, 4, 256, 160


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    return np.log2(context_count + 1.0).astype(np.int64)


def held_out_counts(blocks: DataFrame, answers: DataFrame, n: int) -> np.ndarray:
    """Deleted tokens by (bucket, bin of c(u, v) / c(u), bin of c(v) / N): a table of fixed size. Bin 0 is zero."""

    def count(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows.to_pylist()[0])
        word, pair = block.answered(answers, "kept")
        u = word[block.pairs // len(block.words)]
        v = word[block.pairs % len(block.words)]
        times = np.bincount(block.pair, minlength=len(block.pairs))
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(pair > 0, np.minimum(1 + (-np.log2(pair / u) * P2_STEP).astype(np.int64), P2_BINS - 1), 0)
            p1 = np.where(v > 0, np.minimum(1 + (-np.log2(v / max(n, 1)) * P1_STEP).astype(np.int64), P1_BINS - 1), 0)
        spot = (bucket_of(u) * P2_BINS + p2) * P1_BINS + p1
        key, back = np.unique(spot, return_inverse=True)
        return pa.table({"spot": key, "times": np.bincount(back, weights=times).astype(np.int64)})

    met = blocks.filter("deleted").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda a, b: count(a, b) if len(a) else pa.table({"spot": pa.array([], pa.int64()), "times": pa.array([], pa.int64())}), "spot long, times long"
    )
    rows = met.groupBy("spot").agg(F.sum("times").alias("times")).toArrow()
    return np.stack([rows["spot"].to_numpy(), rows["times"].to_numpy()])


def mixture_weights(counts: np.ndarray, types: int, rounds: int = 60, buckets: int = 64) -> np.ndarray:
    """(l0, l1, l2) of every bucket by expectation-maximisation; a bucket without data mixes like the nearest lower one."""
    spot, times = counts
    bucket, p2, p1 = spot // (P2_BINS * P1_BINS), spot // P1_BINS % P2_BINS, spot % P1_BINS
    model = np.stack(
        [
            np.full(len(spot), 1.0 / (types + 1)),
            np.where(p1 > 0, 2.0 ** (-(p1 - 0.5) / P1_STEP), 0.0),
            np.where(p2 > 0, np.minimum(1.0, 2.0 ** (-(p2 - 0.5) / P2_STEP)), 0.0),
        ],
        axis=1,
    )
    weight = np.full((buckets, 3), 1.0 / 3)
    weight[0] = (0.5, 0.5, 0.0)  # no context, no pairs
    seen = np.zeros(buckets)
    np.add.at(seen, bucket, times)
    for _ in range(rounds):
        part = weight[bucket] * model
        part *= (times / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        new = np.zeros_like(weight)
        np.add.at(new, bucket, part)
        have = new.sum(axis=1) > 0
        weight[have] = (new[have] + 1e-3 * weight[have]) / (new[have].sum(axis=1) + 1e-3)[:, None]
    for b in range(2, buckets):
        if not seen[b]:
            weight[b] = weight[b - 1]
    if not seen[1]:
        weight[1] = weight[0] * 0.9 + np.array([0.0, 0.0, 0.1])
    return weight


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, held_out: int = 2, deleted: int = 3, by: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the base (add-one unigram) and the model's log10 probability of its text.

    Documents learn when crc32 of their id mod ``by`` is not ``held_out``; those at ``deleted`` are the part on which the
    weights are learned. Null and empty texts are one end token; rows without an id are scored and not learned from;
    repeated rows count each; an empty table gives an empty one. With no training text every token is unseen.
    """
    part = F.coalesce(crc_mod(key, by), F.lit(held_out)).cast("int").alias("part")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), part)
    blocks = stored(read_blocks(rows, deleted), "blocks")
    bytes_ = blocks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    cells = cells_for(docs.sparkSession, bytes_ * 4.0)
    answers = stored(answer(ask(blocks, held_out, cells)), "answers")
    n, kept_n, types, kept_types = (int(x or 0) for x in answers.agg(*[F.sum(c) for c in ("n", "kept_n", "types", "kept_types")]).first())
    weight = mixture_weights(held_out_counts(blocks, answers, kept_n), kept_types)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows.to_pylist()[0])
        word, pair = block.answered(answers, "total")
        u, v = block.pairs // len(block.words), block.pairs % len(block.words)
        mix = weight[bucket_of(word[u])]
        p2 = np.where(word[u] > 0, pair / np.maximum(word[u], 1), 0.0)
        log = np.log10(mix[:, 0] / (types + 1) + mix[:, 1] * word[v] / max(n, 1) + mix[:, 2] * p2)
        base = np.log10((word + 1.0) / (n + types + 1.0))
        owner = np.repeat(np.arange(len(block.docs)), block.lengths)

        def per_doc(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=values, minlength=len(block.docs))

        known = block.parts >= 0
        return pa.table(
            {
                "doc_id": pa.array(block.docs, pa.int64(), mask=~known), "held_out": pa.array((block.parts == held_out) | ~known),
                "n_tokens": block.lengths, "n_known": per_doc(word[block.tokens] > 0).astype(np.int64),
                "train_tokens": np.full(len(block.docs), n, np.int64), "base_score": per_doc(base[block.tokens]), "score": per_doc(log[block.pair]),
            }
        )

    return blocks.groupBy("block").cogroup(answers.select("block", "cell", "total").groupBy("block")).applyInArrow(score, SCHEMA)


@query()
def op7_lm_scoring(spark, folder):
    """All documents under the interpolated model."""
    return lm_scores(documents(spark, folder))
