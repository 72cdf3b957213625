"""Removal of repeated passages by suffix sorting with bucket-pointer refinement.

Every byte covered by a `length`-byte string that also starts in a document of a smaller id is removed. Suffixes are
sorted only as deep as `length`, and only where they can have an equal:

1. Initial buckets. Each window of `length` bytes is assigned to the q-gram in it with the smallest hash; this depends on
   the window alone, so equal windows share the q-gram's bucket. Consecutive windows of one q-gram are a class. Buckets
   that one document alone has are finished; the others go on.
2. Refinement by the identifier of what follows: the members of a bucket are split by the hash of the class's whole region;
   windows of equal regions are equal, and the document of the smallest id owns them. The different regions of a bucket go on
   only where a longer string is equal: half of a class's windows hold the bytes before the q-gram too, the other half the
   bytes after it, and either string makes a smaller bucket (by 16 bits of its hash). Where one document owns all regions
   of such a bucket, it is finished.
3. Refinement within the buckets that are left: the owners' regions meet, and their suffixes are sorted by 8-gram bucket,
   then by pairs of bucket pointers at offsets 8, 16 and on up to `length`, each round reusing the last round's pointers.

Documents are dealt by a hash of their id into file buckets of a few MB, written once; later rounds read them in place, and
only hashes, verdicts and the regions of round 3 are shuffled. Each file bucket sends a q-gram or a region once, so a passage in
a third of all documents is as many rows as there are file buckets; a bucket of many different regions is dealt anew by the
hash of single windows. An answer to a file bucket is a bit or a byte for each value it sent, in the order sent, which it makes
again from its documents; q-grams are sent as 32 bits, since two that look alike only go on one round further.

Bytes are UTF-8; spans may cut a character, so what is kept is binary. Defined cases: null counts as empty; a text shorter than
`length` loses nothing; null ids are larger than all others; rows that share an id do not remove each other's bytes; an
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ngram_join import _BYTE, _INVERSE, _STEP, _powers, mixed

GRAM = 21  #: bytes of a q-gram
PLACE = np.uint64((1 << 24) - 1)  #: low bits that hold a place in a chunk
CHUNK = 1 << 20  #: bytes that are scanned at once; a longer document is scanned in pieces
NO_ID = np.iinfo(np.int64).max
#: More different regions than this in a bucket: its windows are dealt one by one.
CROWDED = 64
#: Of a region's windows with one tag: they go on as one piece, or one by one. Of a region: another file bucket's document owns it.
WHOLE, SINGLE, BEATEN = 1, 2, 16
MESSAGE = "dest int, bucket int, a binary, b binary, c binary, d binary"


@dataclass
class Classes:
    """Of consecutive windows that share their q-gram: its hash, the region's hash, the document, first window and number of windows.

    lead: bytes from the first window to the q-gram. before, after: 16 bits that stand for the q-gram with what is before and
    after it, which the windows hold that begin `half` bytes before it or earlier, and the others; 0 where there are none.
    """

    gram: np.ndarray
    region: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    before: np.ndarray
    after: np.ndarray


FIELDS = ("gram", "region", "doc", "first", "count", "lead", "before", "after")
TYPES = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint16, np.uint16)


def halfway(length: int) -> int:
    return (length - GRAM) // 2 + 1


def _scan(raw: np.ndarray, bounds: np.ndarray, length: int) -> Classes:
    """raw: documents one after another; bounds: where they begin, and the end."""
    n = len(raw) - length + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(int(_STEP), len(raw)), out=total[1:])
    inverse = _powers(int(_INVERSE), len(raw))
    h = mixed((total[GRAM:] - total[:-GRAM]) * inverse[: len(raw) - GRAM + 1])
    low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    inside = np.zeros(n, bool)
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - start >= length:
            inside[start : end - length + 1] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return Classes(*[np.zeros(0, t) for t in TYPES])
    owner = (low[at] & PLACE).astype(np.int64)
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    doc_of = np.searchsorted(bounds, at, side="right") - 1
    new[1:] |= doc_of[1:] != doc_of[:-1]
    cut = np.flatnonzero(new)
    first = at[cut]
    count = np.diff(np.concatenate([cut, [len(at)]]))
    region = mixed((total[first + count + length - 1] - total[first]) * inverse[first] + count.astype(np.uint64))
    doc = doc_of[cut]
    place, half = owner[cut], halfway(length)
    lead = place - first

    def tag(some: np.ndarray, back: int, size: int) -> np.ndarray:
        out, start = np.zeros(len(cut), np.uint16), place[some] - back
        out[some] = 1 + mixed((total[start + size] - total[start]) * inverse[start]) % np.uint64(65_535)
        return out

    before, after = tag(lead >= half, half, half + GRAM), tag(lead - count + 1 < half, 0, length - half + 1)
    return Classes(h[place], region, doc, first - bounds[doc], count, lead, before, after)


def _long(raw: np.ndarray, most: int, length: int) -> list[Classes]:
    """The classes of one document, in pieces of `most` bytes. A piece's last class may go on: the next piece begins at its first window."""
    parts, at = [], 0
    while True:
        piece = raw[at : at + most]
        found = _scan(piece, np.array([0, len(piece)]), length)
        found.first = found.first + at
        if at + most >= len(raw):
            return [*parts, found]
        at = int(found.first[-1])
        parts.append(Classes(*[getattr(found, f)[:-1] for f in FIELDS]))


def scan(texts: list[bytes], length: int) -> Classes:
    parts, run, size, base = [], [], 0, 0
    # A piece's places fit into PLACE, and it has more windows than a class can.
    most = max(min(CHUNK, int(PLACE) + 1), 2 * length)
    if most > int(PLACE) + 1:
        raise ValueError(f"length {length} is too large: at most {(int(PLACE) + 1) // 2}")
    for i, t in enumerate([*texts, b""]):
        if run and (i == len(texts) or size + len(t) > most):
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in run])])
            if bounds[-1] >= length:
                raw = np.frombuffer(b"".join(run), np.uint8)
                for found in [_scan(raw, bounds, length)] if len(raw) <= most else _long(raw, most, length):
                    found.doc = found.doc + base
                    parts.append(found)
            run, size, base = [], 0, i
        if i < len(texts):
            run.append(t)
            size += len(t)
    if not parts:
        return _scan(np.zeros(length, np.uint8), np.array([0, 0]), length)
    return Classes(*[np.concatenate([getattr(p, f) for p in parts]) for f in FIELDS])


def dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: the zeros of small numbers stand together and compress."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def messages(dest: np.ndarray, bucket: np.ndarray | int, *columns: np.ndarray) -> pd.DataFrame:
    """One row per (dest, bucket): the columns' values as bytes, in the order given."""
    bucket = np.broadcast_to(np.asarray(bucket), dest.shape)
    order = np.lexsort([bucket, dest])
    dest, bucket = dest[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], (dest[1:] != dest[:-1]) | (bucket[1:] != bucket[:-1])])) if len(dest) else np.zeros(0, np.int64)
    out = {"dest": dest[cut].astype(np.int32), "bucket": bucket[cut].astype(np.int32)}
    for name, values in zip("abcd", [*columns, *[None] * (4 - len(columns))], strict=True):
        out[name] = [b""] * len(cut) if values is None else [planes(p) for p in np.split(values[order], cut[1:])] if len(cut) else []
    return pd.DataFrame(out)


def values(rows: pd.DataFrame, name: str, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(x, np.uint8).reshape(width, -1).T for x in rows[name]]
    return np.concatenate([np.zeros((0, width), np.uint8), *parts]).reshape(-1).view(kind)


def low(hashes: np.ndarray) -> np.ndarray:
    """Of a dealt hash 32 bits: those that do not say where it was dealt to."""
    return hashes.astype(np.uint32)


def runs_of(dest: np.ndarray, n: int) -> np.ndarray:
    """Where each destination's values begin in the order sent, and the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(dest, minlength=n))])


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (the first leads), and where a new value of the keys begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def pointers(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of the length-byte strings at the places `at` of data: equal exactly where the strings are.

    Only places whose identifier a later round reads are sorted.
    """
    steps, depth = [], 8
    while depth < length:
        steps.append(min(depth, length - depth))
        depth += steps[-1]
    needed = [np.zeros(len(data), bool)]
    needed[0][at] = True
    for step in reversed(steps):
        wider = needed[0].copy()
        wider[step:] |= needed[0][:-step]
        needed.insert(0, wider)
    place = np.flatnonzero(needed[0])
    grams = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    pointer = np.zeros(len(data), np.int64)
    pointer[place] = np.unique(grams[place], return_inverse=True)[1]
    for step, mask in zip(steps, needed[1:], strict=True):
        place = np.flatnonzero(mask)
        pair = pointer[place] * (int(pointer.max()) + 1) + pointer[place + step]
        pointer[place] = np.unique(pair, return_inverse=True)[1]
    return pointer[at]


def met(bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which members are in a bucket of several documents."""
    least, most = np.full(int(bucket.max()) + 1, NO_ID), np.full(int(bucket.max()) + 1, -NO_ID - 1)
    np.minimum.at(least, bucket, doc)
    np.maximum.at(most, bucket, doc)
    return (least < most)[bucket]


def spans(docs: DataFrame, length: int = 50, bucket_bytes: int = 6 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (array of start, end in bytes), kept (binary)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = int(max(C.shuffle_partitions(spark), -(-size // bucket_bytes)))
    name = f"passages_{uuid.uuid4().hex}"
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    with C.freed_shuffles(spark):
        rows.repartition(n, "bucket").write.bucketBy(n, "bucket").sortBy("bucket").option("compression", "zstd").option("path", C.noted(f"{C.shared_dir(spark)}/{name}")).saveAsTable(name)
    filed = spark.table(name)
    spark.sql(f"drop table {name}")  # the name alone: the files are external

    half = halfway(length)

    def opened(part: pd.DataFrame) -> tuple[Classes, np.ndarray, list[bytes]]:
        texts = [bytes(t) for t in part["raw"]]
        ids = part["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        found = scan(texts, length)
        return found, ids, texts

    def grams(part: pd.DataFrame) -> pd.DataFrame:
        """Each q-gram of the file bucket, and a bit that says whether several of its documents have it."""
        found, ids, _ = opened(part)
        gram, doc = found.gram, ids[found.doc]
        order, new = first_of(gram, doc)
        gram = gram[order][new]
        one, count = np.unique(gram, return_counts=True)
        sent = messages(dealt(one, n), int(part["bucket"].iloc[0]), low(one), (count > 1).astype(np.uint8))
        return sent.assign(b=[np.packbits(np.frombuffer(x, np.uint8)).tobytes() for x in sent["b"]])

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        """To each file bucket a bit for each of its q-grams: whether it is shared, with another bucket or among its documents."""
        size = np.array([len(x) // 4 for x in part["a"]])
        gram = values(part, "a", np.uint32)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(part["b"], size, strict=True)])
        _, place, count = np.unique(gram, return_inverse=True, return_counts=True)
        keep = ((count > 1) | (np.bincount(place, several) > 0))[place]
        bits = [np.packbits(x).tobytes() for x in np.split(keep, np.cumsum(size)[:-1])]
        return answers(part, bits)

    def answers(part: pd.DataFrame, bits: list[bytes]) -> pd.DataFrame:
        out = pd.DataFrame({"dest": part["bucket"].astype(np.int32), "bucket": part["dest"].astype(np.int32), "a": bits, "b": b"", "c": b"", "d": b""})
        return out[[any(x) for x in bits]]

    def kept_classes(found: Classes, told: pd.DataFrame) -> np.ndarray:
        """Which classes have a shared q-gram, by the answers of round 1."""
        one, place = np.unique(found.gram, return_inverse=True)
        dest = dealt(one, n)
        begins, bits = runs_of(dest, n), np.zeros(len(one), bool)
        for d, x in zip(told["bucket"], told["a"], strict=True):
            bits[begins[d] : begins[d + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=begins[d + 1] - begins[d])
        keep = np.zeros(len(one), bool)
        keep[np.argsort(dest, kind="stable")] = bits
        return keep[place]

    def different(found: Classes, ids: np.ndarray, told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes with a shared q-gram; of each of their regions the first class, that of the smallest id; each class's region; where each region is dealt to."""
        kept = np.flatnonzero(kept_classes(found, told))
        keys = found.gram[kept], found.region[kept]
        order, _ = first_of(*keys, ids[found.doc[kept]])
        new = first_of(*keys)[1]
        place = np.zeros(len(kept), np.int64)
        place[order] = np.cumsum(new) - 1
        least = kept[order[new]]
        return kept, least, place, dealt(found.gram[least], n)

    def regions(docs_part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Each shared q-gram's regions, with the smallest id of the file bucket and both tags."""
        if not len(docs_part) or not len(told):
            return messages(np.zeros(0, np.int64), 0)
        found, ids, _ = opened(docs_part)
        _, least, _, dest = different(found, ids, told)
        tags = found.after[least].astype(np.uint32) << np.uint32(16) | found.before[least]
        return messages(dest, int(docs_part["bucket"].iloc[0]), low(found.gram[least]), found.region[least], ids[found.doc[least]], tags)

    def owners(part: pd.DataFrame) -> pd.DataFrame:
        """To each file bucket a byte for each of its regions: BEATEN if another bucket's document owns it, else the two tags' verdicts."""
        gram, region, doc, tags = values(part, "a", np.uint32), values(part, "b", np.uint64), values(part, "c", np.int64), values(part, "d", np.uint32)
        order, new = first_of(gram, region, doc)[0], first_of(gram, region)[1]
        place = np.cumsum(new) - 1
        own = order[new]
        told = np.zeros(len(own), np.uint8)
        for shift in (0, 2):
            tag = tags[own] >> np.uint32(8 * shift) & np.uint32(0xFFFF)
            some = np.flatnonzero(tag)
            if len(some):
                _, bucket, count = np.unique(gram[own[some]].astype(np.uint64) << np.uint64(16) | tag[some], return_inverse=True, return_counts=True)
                verdict = np.where(met(bucket, doc[own[some]]), np.where(count[bucket] > CROWDED, SINGLE, WHOLE), 0)
                told[some] |= (verdict << shift).astype(np.uint8)
        out = np.zeros(len(order), np.uint8)
        out[order] = np.where(doc[order] > doc[own][place], BEATEN, told[place])
        return answers(part, [x.tobytes() for x in np.split(out, np.cumsum([len(x) // 4 for x in part["a"]])[:-1])])

    def bytes_of(docs_part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Covered spans so far (to the own bucket), and what owners have of the regions that go on (dest of n and more).

        told: the answers of round 1, and those of round 2 with n added to their bucket.
        """
        if not len(docs_part) or not len(told):
            return messages(np.zeros(0, np.int64), 0)
        found, ids, texts = opened(docs_part)
        home = int(docs_part["bucket"].iloc[0])
        kept, least, place, to = different(found, ids, told[told["bucket"] < n])
        begins, sent = runs_of(to, n), np.zeros(len(least), np.uint8)
        for d, x in zip(told["bucket"] - n, told["a"], strict=True):
            if d >= 0:
                sent[begins[d] : begins[d + 1]] = np.frombuffer(x, np.uint8)
        verdict = np.zeros(len(least), np.uint8)
        verdict[np.argsort(to, kind="stable")] = sent
        verdict, doc = verdict[place], ids[found.doc[kept]]
        own = doc == ids[found.doc[least]][place]
        rowkey = np.array([row_key(i, t) for i, t in zip(ids, texts, strict=True)], np.uint64)
        covered = spans_of(home, rowkey, found, kept[~own | (verdict == BEATEN)])
        goes = own & (verdict > 0) & (verdict != BEATEN)
        left, verdict = kept[goes], verdict[goes]
        # Of each class the windows whose tag's bucket goes on, from `start` up to `stop`, as one piece or one by one.
        count, lead = found.count[left], found.lead[left]
        cut = np.clip(lead - half + 1, 0, count)
        before, after = verdict & 3, verdict >> 2
        both = (before == after) & (before > 0)
        # A class without windows of one kind has no tag of it, and so no verdict.
        pieces = [(both, np.zeros_like(cut), count, before), (~both & (before > 0), np.zeros_like(cut), cut, before), (~both & (after > 0), cut, count, after)]
        which = np.concatenate([np.flatnonzero(m) for m, *_ in pieces])
        start, stop, kind = (np.concatenate([x[k][x[0]] for x in pieces]) for k in (1, 2, 3))
        row = np.repeat(np.arange(len(which)), np.where(kind == SINGLE, stop - start, 1))
        offset = np.arange(len(row)) - np.searchsorted(row, row)
        crowded, single = kind[row] == SINGLE, left[which[row]]
        first = found.first[single] + start[row] + np.where(crowded, offset, 0)
        count = np.where(crowded, 1, (stop - start)[row])
        parts = [texts[d][f : f + c + length - 1] for d, f, c in zip(found.doc[single], first, count, strict=True)]
        hashes = found.gram[single].copy()
        for i in np.flatnonzero(crowded):
            hashes[i] = xxhash.xxh64_intdigest(parts[i])
        dest = n + dealt(hashes, n)
        if not len(single):
            return covered
        doc = ids[found.doc]
        # Equal windows of one file bucket: the smallest id stands for all; the others are covered.
        windows, more = np.flatnonzero(crowded), []
        stays = np.ones(len(single), bool)
        if len(windows):
            order, _ = first_of(hashes[windows], doc[single][windows])
            _, new = first_of(hashes[windows])
            top = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            beaten = windows[order][doc[single][windows[order]] > doc[single][windows[top]]]
            stays[beaten] = False
            more = [messages(np.full(len(beaten), home), 0, rowkey[found.doc[single[beaten]]], first[beaten].astype(np.int64), np.full(len(beaten), length, np.int64))]
        out, order = [], np.flatnonzero(stays)[np.argsort(dest[stays], kind="stable")]
        for i in np.split(order, np.flatnonzero(np.diff(dest[order])) + 1):
            who = np.stack([doc[single[i]].astype(np.uint64), rowkey[found.doc[single[i]]]], 1).reshape(-1)
            out.append((dest[i[0]], home, b"".join(parts[k] for k in i), planes(count[i].astype(np.int64)), planes(who), planes(first[i].astype(np.int64))))
        sent = pd.DataFrame(out, columns=["dest", "bucket", "a", "b", "c", "d"]).astype({"dest": np.int32, "bucket": np.int32})
        return pd.concat([covered, *more, sent], ignore_index=True)

    def spans_of(home: int, rowkey: np.ndarray, found: Classes, which: np.ndarray) -> pd.DataFrame:
        """The covered bytes of some classes, of which neighbours in a document are one span."""
        doc, first = found.doc[which], found.first[which]
        order = np.lexsort([first, doc])
        doc, first, end = doc[order], first[order], (first + found.count[which])[order] + length - 1
        new = np.ones(len(which), bool)  # a later class of a document ends later
        new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > end[:-1])
        last = np.append(np.flatnonzero(new)[1:], len(which))[: new.sum()] - 1
        return messages(np.full(new.sum(), home), 0, rowkey[doc[new]], first[new].astype(np.int64), (end[last] - first[new]).astype(np.int64))

    def refine(part: pd.DataFrame) -> pd.DataFrame:
        """Suffix sorting of the regions that met; covered windows, to their file buckets."""
        count, who, first = values(part, "b", np.int64), values(part, "c", np.uint64).reshape(-1, 2), values(part, "d", np.int64)
        data = np.frombuffer(b"".join(part["a"]), np.uint8)
        home = np.repeat(part["bucket"].to_numpy(), [len(x) // 8 for x in part["b"]])
        begins = np.concatenate([[0], np.cumsum(count + length - 1)])[:-1]
        of = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        # Windows whose first or last bytes one document alone has are finished.
        for skip in (0, length - 8):
            if len(of):
                alive = met(pointers(data, begins[of] + offset + skip, 8), who[of, 0].astype(np.int64))
                of, offset = of[alive], offset[alive]
        if not len(of):
            return messages(np.zeros(0, np.int64), 0)
        bucket = pointers(data, begins[of] + offset, length)
        doc = who[:, 0].astype(np.int64)[of]
        least = np.full(int(bucket.max()) + 1, NO_ID)
        np.minimum.at(least, bucket, doc)
        later = np.flatnonzero(doc > least[bucket])
        return messages(home[of[later]], 0, who[of[later], 1], first[of[later]] + offset[later], np.full(len(later), length, np.int64))

    def remove(docs_part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(docs_part):
            return pd.DataFrame({"doc_id": [], "n_bytes": [], "removed": [], "kept": []})
        row, first, size = values(told, "a", np.uint64), values(told, "b", np.int64), values(told, "c", np.int64)
        order = np.lexsort([first, row])
        row, first, end = row[order], first[order], (first + size)[order]
        out = []
        for i, t in zip(docs_part["doc_id"], docs_part["raw"], strict=True):
            t = bytes(t)
            key = np.uint64(row_key(NO_ID if pd.isna(i) else int(i), t)) if len(row) else 0
            low, high = np.searchsorted(row, key, "left"), np.searchsorted(row, key, "right")
            gone = merged(first[low:high], end[low:high]) if high > low else []
            keep, at = [], 0
            for s, e in gone:
                keep.append(t[at:s])
                at = e
            out.append((i, len(t), [{"start": s, "end": e} for s, e in gone], b"".join([*keep, t[at:]])))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "removed", "kept"])

    def by_dest(df: DataFrame) -> DataFrame:
        return df.repartition(n, "dest")

    def told(df: DataFrame):
        return df.groupBy("dest")

    own = filed.groupBy("bucket")
    shared_grams = C.staged(by_dest(own.applyInPandas(grams, MESSAGE)).groupBy("dest").applyInPandas(shared, MESSAGE), "passage-grams")
    sent = own.cogroup(told(shared_grams)).applyInPandas(regions, MESSAGE)
    owned = C.staged(by_dest(sent).groupBy("dest").applyInPandas(owners, MESSAGE), "passage-owners")
    both = shared_grams.unionByName(owned.withColumn("bucket", F.col("bucket") + n))
    known = C.staged(own.cogroup(told(both)).applyInPandas(bytes_of, MESSAGE), "passage-regions")
    C.discard(shared_grams, owned)
    sorted_out = by_dest(known.where(F.col("dest") >= n)).groupBy("dest").applyInPandas(refine, MESSAGE)
    covered = C.staged(known.where(F.col("dest") < n).unionByName(sorted_out), "passage-spans")
    C.discard(known)
    return own.cogroup(told(covered)).applyInPandas(remove, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def row_key(doc_id: int, text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, seed=int(doc_id) & (1 << 64) - 1)


def merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans sorted by their start; touching spans are one run."""
    upto = np.maximum.accumulate(end)
    new = np.concatenate([[True], first[1:] > upto[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(first) - 1]])
    return list(zip(first[new].tolist(), upto[last].tolist(), strict=True))
