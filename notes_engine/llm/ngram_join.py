"""N-gram Jaccard self-join: prefixes of rare tokens, extended by combinations of frequent ones, then exact verification.

A document is its set of distinct word shingles (tokens here: 64-bit hashes of
them); documents with one set are one node. Two sets of sizes m and n that are
similar enough miss at most e of each other's tokens, so what must be shared
can be looked for in few of them:

- Tokens are ordered: rare ones first, frequent ones last. A token is frequent
  if it is in the list of frequent tokens; which tokens are there decides the
  work, never the result.
- A rare token is a signature by itself. Frequent tokens fall into classes by
  hash; any two of one class are a signature, as one alone would match too
  often.
- A set's prefix is long enough that e tokens can't hide every signature: the
  rare tokens in it, and in each class the frequent tokens but one, are e + 1
  or more. Of two similar sets, take the prefix that ends first: e + 1 > what
  the other set misses of it, so some rare token or two frequent tokens of one
  class are shared, and are in the other prefix as well.
- The number of classes follows the size of a set, so that combinations stay
  in proportion to it. A set uses the classes for its own size, for the
  largest size that can be similar to it, and for all bit lengths between; a pair meets in those of the larger.

Candidates come from the sets that have a signature. In each group the first
few members are compared to all others; the rest are compared only if the
group still spans several components, more members a round, and only pairs of
two components whose sizes and parity bits allow a link. So a group of many
near copies costs few pairs a member, and no link between two components is
lost.

Near copies meet in many groups. Of groups with the same members one goes on;
and of the groups in which two sets meet, a pair is made only in the first that
the least signatures of both tell of: it is looked at there in this round, or
both sets wait there for a later one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.common import SPACE, UPPER, batches_of, dropped, gathered, let_go, sieved, stored
from notes_engine.llm.components import components
from notes_engine.llm.tokens import in_groups, listed

#: Words in a shingle; similarity in hundredths.
WORDS = 5
PERCENT = 80
#: Tokens that a task counts together; those in LEAST_LOCAL of the sets counted may be frequent, and are if such counts add up to LEAST_FREQUENT.
COUNTED = 4_000_000
LEAST_LOCAL = 2
LEAST_FREQUENT = 12
#: The most frequent tokens that the list holds; it is sent to each task.
MOST_FREQUENT = 1 << 18
#: Tokens of a set for each class of frequent tokens.
SET_PER_CLASS = 16
#: Members of a group that are compared to all others: in the first round, and by what it grows.
LEADERS, GROWTH = 1, 16
#: Rounds in which labels spread along links between such rounds; a component that has several labels yet costs pairs, no results.
SPREAD = 2
#: Bits of the short parity, by which members are told apart before they make a pair.
SHORT_BITS = 1024
#: Least signatures of a set, by which a pair is made in one of the groups in which it meets.
LEAST_KNOWN = 8
#: Pairs that a task remembers, so as not to make them again.
PAIRS_KNOWN = 50_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; for 64-bit hashes faster than np.unique()."""
    h = np.sort(h)
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


def repeated(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that are in h so often at least, ascending, and how often each is. h is sorted in place."""
    h.sort()
    found = h[: max(0, len(h) - least + 1)][h[least - 1 :] == h[: max(0, len(h) - least + 1)]]
    found = found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found
    return found, np.searchsorted(h, found, side="right") - np.searchsorted(h, found)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text, the hashes of its distinct shingles, ascending. Words: between ASCII white space, A-Z in lower case; fewer words than size are one shingle.

    Arrow cuts and codes the words of about GROUP_BYTES of texts; each distinct word is hashed once.
    """
    for group in in_groups(texts):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[group]))
        coded = lists.flatten().dictionary_encode()
        words = listed(coded.dictionary)
        codes, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        if "" in words:  # beside white space at a text's ends
            there = codes != words.index("")
            bounds = np.concatenate(([0], np.cumsum(there)))[bounds]
            codes = codes[there]
        w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[codes]
        h = w[: max(0, len(w) - size + 1)].copy()  # at each word; those that reach into the next text aren't read
        for k in range(1, size):
            h = _mix(h) + w[k : k + len(h)]
        h = _mix(h)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if b - a >= size:
                yield _distinct(h[a : b - size + 1])
            elif b > a:
                yield np.array([xxhash.xxh64_intdigest(" ".join(words[c] for c in codes[a:b].tolist()), seed=b - a)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    return next(shingle_sets(pa.array([text or ""], pa.string()), size))


def node_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8").tolist())


def parity(tokens: np.ndarray, bits: int | None = None) -> bytes:
    """One bit for each residue of the hashes, set if an odd number of tokens have it: of so many residues, or of the first power of two from 64 that the set doesn't exceed."""
    bits = bits or max(64, 1 << (max(1, len(tokens)) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes, m: int, n: int, percent: int = PERCENT) -> bool:
    """Whether two sets of sizes m and n with these parities can be similar enough: the parities differ in no more bits than the sets in tokens."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    differ = int(np.bitwise_count(p ^ q).sum())
    # shared * 100 >= percent * union, with union = m + n - shared
    least_shared = -(-percent * (m + n) // (100 + percent))
    return differ <= m + n - 2 * least_shared


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set (see above); frequent: the list's tokens, ascending."""
    n = len(tokens)
    need = n - -(-percent * n // 100) + 1
    where = np.searchsorted(frequent, tokens)
    often = frequent[np.minimum(where, len(frequent) - 1)] == tokens if len(frequent) else np.zeros(n, bool)
    rare, often = tokens[~often], tokens[often]
    if len(rare) >= need:
        return rare[:need]
    found = [rare]
    for tag in range(n.bit_length(), (100 * n // percent).bit_length() + 1):
        classes = max(1, (1 << (tag - 1)) // SET_PER_CLASS)
        kind = (_mix(often) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        later = np.zeros(len(often), np.int64)  # 1: not the first of its class
        later[order[1:]] = kind[order[1:]] == kind[order[:-1]]
        enough = np.flatnonzero(np.cumsum(later) + len(rare) >= need)
        used, kind = (often[: enough[0] + 1], kind[: enough[0] + 1]) if len(enough) else (often, kind)
        order = np.argsort(kind, kind="stable")
        used, kind = _mix(used[order] + np.uint64(tag)), kind[order]
        for gap in count(1):
            same = np.flatnonzero(kind[gap:] == kind[:-gap]) if gap < len(kind) else np.zeros(0, int)
            if not len(same):
                break
            found.append(_mix(used[same] * np.uint64(3) + used[same + gap]))  # by place: the order is that of the tokens in both sets
    return np.concatenate(found)


def _batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _read_sets(docs: DataFrame, size: int) -> DataFrame:
    """A row per document (its node, set size and parity), and rows of tokens that may be frequent, with counts."""
    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, _tie long, n long, a long, b long, parity binary, short binary, token long, times long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(COUNTED, np.uint64)  # the tokens of the sets counted, in one place that is sorted where it is
        filled = 0
        seen: set[tuple[int, int]] = set()
        names = ["_id", "_tie", "n", "a", "b", "parity", "short", "token", "times"]
        kind = pa.null()

        def frequent() -> Iterator[pa.RecordBatch]:
            nonlocal filled
            token, times = repeated(held[:filled], LEAST_LOCAL)
            for at in range(0, len(token), 100_000):
                part = slice(at, at + 100_000)
                k = len(token[part])
                none = lambda t, k=k: pa.nulls(k, t)
                yield _batch(names, none(kind), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.binary()), token[part].view(np.int64), times[part])
            filled = 0
            seen.clear()

        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for tokens in shingle_sets(batch.column(2), size):
                node = node_of(tokens)
                rows.append((len(tokens), *node, parity(tokens), parity(tokens, SHORT_BITS)))
                if node not in seen:
                    seen.add(node)
                    if filled + len(tokens) > len(held):
                        yield from frequent()
                        seen.add(node)
                        if len(tokens) > len(held):
                            held = np.empty(len(tokens), np.uint64)
                    held[filled : filled + len(tokens)] = tokens
                    filled += len(tokens)
            n, a, b, bits, short = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n, a, b)), pa.array(bits, pa.binary()), pa.array(short, pa.binary()), none, none], names=names)
        yield from frequent()
        del held
        let_go()

    return stored(docs.mapInArrow(read, schema), "sets")


def _postings(docs: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """(sig, a, b, n): each set's signatures; a task leaves out sets that it has just seen."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sig, nodes = [], []
            for tokens in shingle_sets(batch.column(0), size):
                if len(tokens) and (node := node_of(tokens)) not in seen:
                    seen.add(node)
                    found = signatures(tokens, frequent, percent)
                    sig.append(found)
                    nodes.append((*node, len(tokens), len(found)))
            if nodes:
                a, b, n, k = (np.array(c, np.int64) for c in zip(*nodes, strict=True))
                yield _batch(["sig", "a", "b", "n"], np.concatenate(sig).view(np.int64), np.repeat(a, k), np.repeat(b, k), np.repeat(n, k))
            if len(seen) > 200_000:
                seen.clear()
        let_go()

    return docs.select("_text").mapInArrow(made, "sig long, a long, b long, n long")


def _pairs(postings: DataFrame, leaders: int, percent: int) -> DataFrame:
    """Candidate pairs, and what is left for later: rows of (first, sig, a, b, n, a2, b2, n2).

    postings: (sig, a, b, n), and after the first round c, the node's component
    so far or its own, short, its short parity, and least, the LEAST_KNOWN least
    signatures that it has here, ascending, the last repeated. Sorted by sig, a
    partition is read once; of each group only the first members are remembered.
    first: this row is a pair of a first member (a2, b2) and a later one of
    another component whose sizes and parities allow a link, and for which least
    tells of no earlier group that has both; else it is a member
    that isn't among the first and is compared with the others in a later round
    (a2, b2, n2 are null); one alone has no others and is left out.
    """
    names = ["first", "sig", "a", "b", "n", "a2", "b2", "n2"]
    words = SHORT_BITS // 64
    by_parity = "short" in postings.columns
    columns = ["sig", "a", "b", "n", *["c"] * by_parity]

    def told_of(batch: pa.RecordBatch) -> np.ndarray:
        """By row: the words of the short parity, then the least signatures."""
        if not by_parity:
            return np.zeros((batch.num_rows, 0), np.uint64)
        short = np.frombuffer(b"".join(batch.column("short").to_pylist()), np.uint64).reshape(-1, words)
        return np.concatenate((short, batch.column("least").flatten().to_numpy().view(np.uint64).reshape(-1, LEAST_KNOWN)), axis=1)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros((len(columns), 0), np.int64), np.zeros((0, (words + LEAST_KNOWN) * by_parity), np.uint64)
        kept, kept_bits = empty  # the first members of the group that is open
        length, last = 0, None  # of that group; its last member
        made: set[tuple[int, ...]] = set()
        waiting = None  # its first member that isn't among the first, as long as it is alone
        nothing = lambda n: [pa.nulls(n, pa.int64())] * 3
        for batch in batches:
            rows, bits = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]), told_of(batch)
            before = np.concatenate(([[*last]] if last is not None else [[rows[0, 0] ^ 1, 0, 0]], rows[:3].T[:-1]))
            fresh = (rows[:3].T != before).any(axis=1)  # not the same set from another task
            rows, bits = rows[:, fresh], bits[fresh]
            if not rows.shape[1]:
                continue
            last = rows[:3, -1]
            if not kept.shape[1] or kept[0, 0] != rows[0, 0]:
                (kept, kept_bits), length, waiting = empty, 0, None
            old = kept.shape[1]
            rows, bits = np.concatenate((kept, rows), axis=1), np.concatenate((kept_bits, bits))
            begins = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
            sizes = np.diff(np.append(begins, rows.shape[1]))
            begin = np.repeat(begins, sizes)
            place = np.arange(rows.shape[1]) - begin
            place[old : sizes[0]] += length - old
            new = np.arange(rows.shape[1]) >= old
            later = np.flatnonzero(new & (place > 0))
            for k in range(leaders):
                later = later[place[later] > k]
                if not len(later):
                    break
                i, j = later, begin[later] + k
                m, n = rows[3, i], rows[3, j]
                good = 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
                if by_parity:
                    good &= rows[4, i] != rows[4, j]
                i, j = i[good], j[good]
                if by_parity and len(i):
                    m = rows[3, i] + rows[3, j]
                    differ = np.bitwise_count(bits[i, :words] ^ bits[j, :words]).sum(axis=1, dtype=np.int64)
                    good = differ <= m - 2 * -(-percent * m // (100 + percent))
                    i, j = i[good], j[good]
                    x, y = bits[i, words:].view(np.int64), bits[j, words:].view(np.int64)
                    earlier = np.zeros(len(i), bool)
                    for c in range(LEAST_KNOWN):
                        earlier |= (x[:, c] < rows[0, i]) & (y == x[:, c, None]).any(axis=1)
                    i, j = i[~earlier], j[~earlier]
                # A pair that this task has just made needs no second row.
                told = list(zip(*rows[1:3, i].tolist(), *rows[1:3, j].tolist(), strict=True))
                new_pairs = []
                for at, p in enumerate(told):
                    if p not in made:
                        made.add(p)
                        new_pairs.append(at)
                i, j = i[new_pairs], j[new_pairs]
                if len(i):
                    yield _batch(names, np.ones(len(i), bool), *rows[:4, i], *rows[1:4, j])
                if len(made) > PAIRS_KNOWN:
                    made.clear()
            members = sizes + np.where(np.arange(len(sizes)) == 0, length - old, 0)
            alone = members == leaders + 1
            i = np.flatnonzero((place >= leaders) & new & ~np.repeat(alone, sizes))
            if waiting is not None and not alone[0]:
                yield _batch(names, np.zeros(1, bool), *waiting[:4, None], *nothing(1))
                waiting = None
            if len(i):
                yield _batch(names, np.zeros(len(i), bool), *rows[:4, i], *nothing(len(i)))
            waiting = rows[:, -1] if alone[-1] else None
            keep = slice(begins[-1], begins[-1] + min(leaders, sizes[-1]))
            kept, kept_bits, length = rows[:, keep], bits[keep], int(place[-1]) + 1

    dealt = postings.select(*columns, *["short", "least"] * by_parity).repartition("sig").sortWithinPartitions("sig", "a", "b")
    return dealt.mapInArrow(paired, "first boolean, sig long, a long, b long, n long, a2 long, b2 long, n2 long")


def _left(rest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, a, b, n, c, short, least) of the groups of rest (sig, a, b, n, c) that span several components, one of those with the same members. nodes: (a, b, short).

    Members' names are hashes of 128 bits, so groups of as many members whose names have the same xor are taken for the same.
    """
    groups = rest.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"), F.count(F.lit(1)).alias("members"))
    groups = groups.where("low < high").groupBy("x", "y", "members").agg(F.min("sig").alias("sig")).select("sig")
    kept = rest.join(groups, "sig", "left_semi")
    sigs = F.sort_array(F.collect_list("sig")).alias("sigs")
    least = F.slice(F.concat("sigs", F.array_repeat(F.element_at("sigs", -1), LEAST_KNOWN)), 1, LEAST_KNOWN).alias("least")
    told = kept.groupBy("a", "b").agg(sigs).select("a", "b", least).join(nodes.select("a", "b", "short"), ["a", "b"])
    return kept.join(told, ["a", "b"]).select("sig", "a", "b", "n", "c", "short", "least")


def _ends(pairs: DataFrame) -> DataFrame:
    """(a, b, one, two): the sets of the pairs, and whether each is the one or the other of some pair."""
    ends = pairs.select("a", "b", F.lit(True).alias("one"), F.lit(False).alias("two")).union(pairs.select("a2", "b2", F.lit(False), F.lit(True)))
    return ends.groupBy("a", "b").agg(F.bool_or("one").alias("one"), F.bool_or("two").alias("two"))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, a2, b2) whose parities allow a link. nodes: (a, b, parity)."""

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, m, n = (batch.column(c).to_pylist() for c in ("parity", "parity2", "n", "n2"))
            good = [may_be_similar(*p, percent) for p in zip(x, y, m, n, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b", "a2", "b2"])

    bits = nodes.select("a", "b", "parity")
    both = pairs.join(bits, ["a", "b"]).join(_second(bits, "parity"), ["a2", "b2"])
    return both.select("a", "b", "n", "parity", "a2", "b2", "n2", "parity2").mapInArrow(sifted, "a long, b long, a2 long, b2 long")


def _second(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col(column).alias(f"{column}2"))


def _token_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(a, b, one, two, tokens) of the wanted sets (a, b, one, two), written, made anew from one text of each (a row that is repeated may give more). nodes: (a, b, _id, _tie); docs: (_id, _tie, _text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            for k, node in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if node not in seen:
                    seen.add(node)
                    keep.append(k)
            if len(seen) > 200_000:
                seen.clear()
            *told, texts = (batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b", "one", "two", "_text"))
            yield pa.RecordBatch.from_arrays([*told, pa.array([t.tobytes() for t in shingle_sets(texts, size)], pa.binary())], names=["a", "b", "one", "two", "tokens"])
        let_go()

    keys = stored(gathered(wanted.join(nodes, ["a", "b"]).select("a", "b", "one", "two", F.col("_id").alias("_key"), F.col("_tie").alias("_key_tie"))), "keys")
    texts = sieved(docs, F.xxhash64("_id", "_tie"), keys, F.xxhash64("_key", "_key_tie")).join(keys, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_key_tie") == F.col("_tie"))).select("a", "b", "one", "two", "_text")
    made = stored(gathered(texts.mapInArrow(sets, "a long, b long, one boolean, two boolean, tokens binary")), "tokens")
    dropped(keys)
    return made


def _verified(likely: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, a2, b2) whose sets are similar. Each set is sent only as what it is in some pair."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in ("tokens", "tokens2"))
            good = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in p), percent) for p in zip(x, y, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b", "a2", "b2"])
        let_go()

    both = likely.join(tokens.where("one").select("a", "b", "tokens"), ["a", "b"]).join(_second(tokens.where("two"), "tokens"), ["a2", "b2"])
    return both.select("a", "b", "a2", "b2", "tokens", "tokens2").mapInArrow(compared, "a long, b long, a2 long, b2 long")


def _thinned(found: DataFrame) -> DataFrame:
    """Links (x, y) that hold the same sets together as found: each first set with the least of its second sets, and that with the others, which few are."""
    node = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    told = found.groupBy(node("a", "b").alias("x")).agg(F.min(node("a2", "b2")).alias("y"), F.collect_set(node("a2", "b2")).alias("others"))
    return told.select(F.explode(F.array_append("others", F.col("x"))).alias("x"), "y").where("x <> y").distinct()


def ngram_join(docs: DataFrame, *, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (least id with the same set), component_id (least id reachable by links).

    Documents link when 100 * shared >= percent * union of their shingle sets.
    Sets are compared by 64-bit hashes of their shingles. Null and empty texts,
    and texts of white space: no shingles, linked with nothing, their own class
    and component. Null ids: they join components, but name one only where it
    has no other id (null then). Repeated rows: each gets the row of its set.
    Very long texts: memory and signatures in proportion to their words. Empty
    table: no rows.
    """
    with batches_of(docs.sparkSession):
        return _joined(docs, size, percent, id_col, text_col)


def _joined(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_tie"), F.coalesce(text_col, F.lit("")).alias("_text"))
    read = _read_sets(rows, size)
    members = read.where("token IS NULL").select("_id", "_tie", "n", "a", "b", "parity", "short")
    often = read.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST_FREQUENT).orderBy(F.desc("times"), "token").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r.token for r in often.select("token").toLocalIterator()], np.int64).view(np.uint64))
    one = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_tie").alias("tie"))).alias("r")
    nodes = members.where("n > 0").groupBy("a", "b", "n").agg(one, F.first("parity").alias("parity"), F.first("short").alias("short"))
    nodes = stored(gathered(nodes.select("a", "b", "n", "parity", "short", F.col("r.id").alias("_id"), F.col("r.tie").alias("_tie"))), "nodes")

    left = _postings(rows, frequent, size, percent)
    links: list[DataFrame] = []
    reached, leaders, changed = None, LEADERS, False
    while True:
        made = stored(gathered(_pairs(left, leaders, percent)), "pairs")
        pairs = made.where("first").select("a", "b", "n", "a2", "b2", "n2").distinct()
        some, ends = nodes, None
        if leaders > LEADERS:  # later pairs have few of the sets, so others aren't sent
            ends = stored(gathered(_ends(pairs)), "ends")
            some = sieved(nodes, F.xxhash64("a", "b"), ends, F.xxhash64("a", "b"))
        likely = stored(gathered(_likely(pairs, some, percent)), "likely")
        tokens = _token_sets(_ends(likely), some, rows, size)
        more = stored(gathered(_thinned(_verified(likely, tokens, percent))), "links")
        dropped(likely, tokens, ends)
        if not links or not more.isEmpty():
            links.append(more)
            changed = True
        if made.where(~F.col("first")).isEmpty():
            dropped(made)
            break
        if changed:
            dropped(reached)
            reached = components(reduce(DataFrame.union, links), SPREAD)
            changed = False
        labels = reached.select("node.a", "node.b", "label")
        # What is left: groups whose members, without those compared to all, lie in several components.
        rest = made.where(~F.col("first")).select("sig", "a", "b", "n").join(labels, ["a", "b"], "left")
        rest = stored(gathered(rest.select("sig", "a", "b", "n", F.when(F.col("label").isNull(), F.xxhash64("a", "b")).otherwise(F.xxhash64("label.a", "label.b")).alias("c"))), "rest")
        dropped(made, left)
        left = stored(gathered(_left(rest, nodes)), "left")
        dropped(rest)
        if left.isEmpty():
            break
        leaders *= GROWTH
    dropped(left, reached)
    reached = components(reduce(DataFrame.union, links)).select("node.a", "node.b", "label")
    dropped(*links)
    named = nodes.join(reached, ["a", "b"], "left").select("a", "b", "_id", F.coalesce("label", F.struct("a", "b")).alias("label"))
    least_id = named.groupBy("label").agg(F.min("_id").alias("component_id"))
    classes = named.join(least_id, "label").select("a", "b", F.col("_id").alias("class_id"), "component_id")
    own = F.col("n") == 0
    return members.join(classes, ["a", "b"], "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(own, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ngram_join() over all documents."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of sets that share a shingle are counted, and labels spread along links: for small tables.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SPACE}'), lambda x: x <> '') AS w FROM documents
), t AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) >= {WORDS} THEN list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), c AS (
  SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM t
), node AS (
  SELECT class_id, len(s) AS n, unnest(s) AS x FROM c WHERE doc_id = class_id
), link AS (
  SELECT a.class_id AS p, b.class_id AS q FROM node a JOIN node b ON a.x = b.x AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), reach AS (
  SELECT DISTINCT class_id AS p, class_id AS label FROM c
  UNION
  SELECT link.q, reach.label FROM reach JOIN link ON link.p = reach.p WHERE reach.label < link.q
), least AS (
  SELECT p AS class_id, min(label) AS component_id FROM reach GROUP BY p
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, class_id, component_id FROM c JOIN least USING (class_id)
"""
