"""Operator 6, token ids in binary files.

Documents are ordered by id over range partitions; each task tokenises its share and writes one file. A file is a row
of segments: a header, the documents' ids and lengths, and blocks of ids coded by ``rangecoder``. Every block starts
afresh from the segment's table of frequencies and has checksums of its coded bytes and of its ids, so a damaged block
is found and harms no other.

    segment  = "EQTOK2\\n\\0"  u32 documents  u32 blocks  u32 length of the tables  u32 crc32 of the tables  tables  blocks
    tables   = documents x (u8 has an id, i64 id, u32 ids)  blocks x (u32 ids, u32 bytes, u32 crc32 of the bytes, u32 crc32 of the ids)
               deflated: u8 ids are halved  u32 symbols  symbols x u32 step from the symbol before  u32 first symbol  symbols x u32 frequency

All numbers are little-endian; ids count as unsigned 32-bit integers in checksums.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rangecoder
from .common import give_back, make_folder, new_path, scratch, tidy
from .warc import _open

MAGIC = b"EQTOK2\n\0"
END = 1
#: A segment is closed at the end of the document with which it has so many ids.
SEGMENT_IDS = 6_000_000
#: Bytes of text that are encoded together, texts of them that the library gets at once, and how many words, and how many
#: pre-tokens, a Python worker remembers from piece to piece.
PIECE, TEXTS, REMEMBERED = 8 << 20, 256, 300_000
#: A printable character below U+0250, but for that whose lower case is two characters.
PLAIN = r"[!-~\x{A1}-\x{12F}\x{131}-\x{24F}]"
DOC = np.dtype([("has", "u1"), ("id", "<i8"), ("n", "<u4")])
BLOCK = np.dtype([("n", "<u4"), ("bytes", "<u4"), ("crc", "<u4"), ("ids_crc", "<u4")])


class Encoder:
    """Ids of whole columns of texts for one tokenizer file; one of these in each Python worker.

    If the tokenizer drops white space and divides texts by a plain pattern (``drops_space``), a text's ids are those of
    its white-space-separated words one after the other, and a word's ids are those of its pre-tokens. So words that are
    remembered aren't divided again, and pre-tokens that are remembered aren't encoded again. That the pattern here (RE2)
    and the library's divide alike is known for printable Latin characters below U+0250 only: a word with any other is
    encoded by the library as a whole, and so is one that holds an added token. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = drops_space(spec)
        if self.by_word:
            vocabulary = spec["model"]["vocab"]
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(1 + max(vocabulary.values()), bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self.pattern = _split_pattern(spec)
            self.added = [t["content"] for t in spec.get("added_tokens", [])]
            # For pre-tokens, which are normalised and divided already, and whose bytes are letters of the byte level.
            whole = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(spec | whole))
            self.letters = _letters()
            self.words, self.pretokens = _Memory(REMEMBERED), _Memory(REMEMBERED)

    def _library(self, texts: list[str], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each text, by the library."""
        own, ids = self.bare if bare else self.tokenizer, []
        for i in range(0, len(texts), TEXTS):  # what the library returns takes some hundred bytes an id
            ids += [np.array(e.ids, np.uint32) for e in own.encode_batch_fast(texts[i : i + TEXTS], add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _new_pretokens(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_library``; many pre-tokens in one text, told apart by the tokens that end a word."""
        ids, _ = self._library(self._joined(pieces, 64), bare=True)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(pieces) or len(ids) and last[-1] != len(ids) - 1:
            return self._library(self._joined(pieces, 1), bare=True)
        return ids, np.diff(last, prepend=-1)

    def _joined(self, pieces: pa.Array, each: int) -> list[str]:
        """Texts of so many pre-tokens each, with a space between them, in letters of the byte level."""
        at = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[at[0] : at[-1]]
        gaps = np.full(len(pieces), ord(" "), "<u4")
        gaps[each - 1 :: each] = gaps[-1:] = ord("\n")
        return np.insert(self.letters.take(data), at[1:] - at[0], gaps).tobytes().decode("utf-32-le").split("\n")[:-1]

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_library``, for distinct words."""
        plain = pc.match_substring_regex(words, f"^{PLAIN}*$")
        for t in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, t)))
        lowered = pc.utf8_lower(words.filter(plain))
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, self.pattern, r"\0 "))
        offsets = pieces.offsets.to_numpy()
        plain_ids, ends = self.pretokens.ids(pieces.flatten(), self._new_pretokens)
        plain_n = ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]
        if len(lowered) == len(words):
            return plain_ids, plain_n
        odd_ids, odd_n = self._library(words.filter(pc.invert(plain)).to_pylist())
        is_plain = plain.to_numpy(zero_copy_only=False)
        n, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        n[is_plain], n[~is_plain] = plain_n, odd_n
        begin[is_plain], begin[~is_plain] = _ends(plain_n)[:-1], len(plain_ids) + _ends(odd_n)[:-1]
        return _gather(np.concatenate([plain_ids, odd_ids]), begin, n), n

    def _piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return self._library(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        offsets = split.offsets.to_numpy().astype(np.int64)
        ids, ends = self.words.ids(split.flatten(), self._new_words)
        return ids, ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one piece of the column after the other: the ids of its texts (uint32), and how many each text has."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE, side="right")))
            yield self._piece(texts.slice(lo, hi - lo))
            lo = hi


class _Memory:
    """Strings that were met before and the ids of each; if there are more than ``room``, half as many stay, those that were met most."""

    def __init__(self, room: int):
        self.room, self.known = room, pa.array([""])  # which has no ids
        self.values, self.at, self.uses = np.zeros(0, np.uint32), np.zeros(2, np.int64), np.zeros(1, np.int64)

    def ids(self, strings: pa.Array, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, one after the other, and where each one's begin (and the end); ``make`` gives new strings' ids and their numbers."""
        if not len(strings):
            return self.values[:0], _ends(np.zeros(0, np.int64))
        if len(self.known) > self.room:
            self._forget()
        # One dictionary for both: the known strings keep their places, new ones follow.
        found = pa.chunked_array([self.known, strings]).dictionary_encode().chunk(1)
        new = found.dictionary.slice(len(self.known))
        if len(new):
            values, n = make(new)
            self.values, self.at = np.concatenate([self.values, values]), np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            self.known = found.dictionary
        which = found.indices.to_numpy()
        uses = np.bincount(which, minlength=len(self.known))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        n = np.diff(self.at).astype(np.int32).take(which)
        return _gather(self.values, self.at.take(which), n), _ends(n)

    def _forget(self) -> None:
        stay = np.sort(np.append(0, 1 + np.argpartition(-self.uses[1:], self.room // 2)[: self.room // 2]))
        begin, n = self.at[stay], np.diff(self.at)[stay]
        self.values, self.at = _gather(self.values, begin, n), _ends(n)
        self.known, self.uses = self.known.take(pa.array(stay)), self.uses[stay] >> 1


def _ends(n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return out


def _gather(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of n values that start at begin, one after the other."""
    ends = _ends(n)
    kind = np.int32 if max(len(values), ends[-1]) < 1 << 31 else np.int64
    at = np.repeat((begin - ends[:-1]).astype(kind), n)
    at += np.arange(ends[-1], dtype=kind)
    return values.take(at)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _split_pattern(spec: dict) -> str:
    pres = spec["pre_tokenizer"]
    return pres.get("pretokenizers", [pres])[0]["pattern"]["Regex"]


def _letters() -> np.ndarray:
    """The character (its number) that stands for each byte on the byte level."""
    from tokenizers.pre_tokenizers import ByteLevel

    letters = np.sort(np.array([ord(c) for c in ByteLevel.alphabet()], "<u4"))
    of = np.arange(256, dtype="<u4")
    of[~np.isin(of, letters)] = letters[letters > 255]  # bytes that aren't printable, in their order
    return of


def drops_space(spec: dict) -> bool:
    """Whether ASCII white space only separates words for this tokenizer, by its file's contents, and words divide by a pattern.

    True for: normalisers that treat characters one by one or map runs of white space to a space, then a split that
    removes all that its pattern doesn't match, with a pattern of plain alternatives that never matches white space and
    always matches a printable character, then the byte level, which divides no further; a model that marks the ends of
    words; and no added token that strips or is found within words only.
    """
    steps = lambda x, key: x.get(key, [x]) if x else []
    norms, pres = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in norms)
    split = pres[0] if pres else {}
    pattern = split.get("pattern", {}).get("Regex", "\\s")
    bare = pattern.replace("[^\\s", "")  # what is left of the pattern must not mention white space
    if not (
        plain and any(n["type"] == "Lowercase" for n in norms)
        and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed"
        and not any(x in bare for x in ("\\s", " ", ".", "[^", "(", "^", "$", "\\b"))
        and [p["type"] for p in pres[1:]] == ["ByteLevel"] and not pres[1]["add_prefix_space"] and not pres[1]["use_regex"]
        and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
    ):
        return False
    each = pa.array([c for c in map(chr, range(33, 0x250)) if not 0x7E < ord(c) < 0xA1 and ord(c) != 0x130])
    return bool(pc.all(pc.match_substring_regex(pc.utf8_lower(each), f"^({pattern})$")).as_py())


def segment(docs: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a segment for documents (DOC) and all their ids (unsigned)."""
    table, coded = rangecoder.encode(ids)
    parts = [ids[i : i + rangecoder.BLOCK] for i in range(0, len(ids), rangecoder.BLOCK)]
    blocks = np.array([(len(p), len(c), zlib.crc32(c), zlib.crc32(p.astype("<u4").tobytes())) for p, c in zip(parts, coded)], BLOCK)
    tables = docs.tobytes() + blocks.tobytes() + table
    return b"".join([MAGIC, struct.pack("<IIII", len(docs), len(blocks), len(tables), zlib.crc32(tables)), tables, *coded])


def read_segments(stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents' table, ids) of each segment; ValueError if anything doesn't fit its checksum."""
    while head := stream.read(24):
        if len(head) < 24 or head[:8] != MAGIC:
            raise ValueError("no segment where one must start")
        n_docs, n_blocks, size, crc = struct.unpack("<IIII", head[8:])
        tables, fixed = stream.read(size), n_docs * DOC.itemsize + n_blocks * BLOCK.itemsize
        if len(tables) != size or zlib.crc32(tables) != crc or size < fixed:
            raise ValueError("the tables of a segment are damaged")
        docs = np.frombuffer(tables, DOC, n_docs)
        blocks = np.frombuffer(tables, BLOCK, n_blocks, n_docs * DOC.itemsize)
        coded = [stream.read(int(b["bytes"])) for b in blocks]
        for k, (c, b) in enumerate(zip(coded, blocks)):
            if len(c) != b["bytes"] or zlib.crc32(c) != b["crc"]:
                raise ValueError(f"block {k} of a segment is damaged")
        ids = rangecoder.decode(tables[fixed:], coded, [int(n) for n in blocks["n"]]).astype("<u4", copy=False)
        del coded
        at = 0
        for k, b in enumerate(blocks):
            if zlib.crc32(ids[at : at + int(b["n"])]) != b["ids_crc"]:
                raise ValueError(f"block {k} of a segment decodes to other ids")
            at += int(b["n"])
        if at != int(docs["n"].sum()):
            raise ValueError("a segment's documents and blocks differ in length")
        yield docs, ids
        del ids


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text: str = "text", end_id: int = END) -> DataFrame:
    """Write the ids of every document, each with ``end_id`` after it, in ascending order of the documents' ids.

    Returns (path, file_no, n_docs, n_ids, bytes) of the files, in their order. Files of tasks that were lost or tried
    twice aren't listed there, and only that list counts. Cases: a null text is empty and has the end id alone; null
    ids come first; rows that repeat an id are ordered by their texts' hashes; an empty table gives no files. Other
    columns play no part. A task holds the ids of one segment at a time, whole documents up to ``SEGMENT_IDS`` ids.
    """
    spark = docs.sparkSession
    folder = make_folder(spark, path or new_path(spark, "tokens"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, name, stream = encoder(tokenizer), f"{folder}/{uuid.uuid4().hex}.tok", None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = n_docs = n_ids = n_bytes = 0

        def flush() -> None:
            nonlocal held, n_held, n_docs, n_ids, n_bytes
            docs, ids = np.concatenate([d for d, _ in held]), np.concatenate([i for _, i in held])
            held = []
            data = segment(docs, ids)
            stream.write(data)
            n_docs, n_ids, n_bytes, n_held = n_docs + len(docs), n_ids + len(ids), n_bytes + len(data), 0

        for b in batches:
            at = 0
            for ids, n in own.encode(b.column(1)):
                if stream is None:
                    stream = _open(name, "w")
                who = b.column(0).slice(at, len(n))
                at += len(n)
                table = np.zeros(len(n), DOC)
                table["has"] = pc.is_valid(who).to_numpy(zero_copy_only=False)
                table["id"], table["n"] = pc.fill_null(who, 0).to_numpy(zero_copy_only=False), n + 1
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                held.append((table, ids.astype(np.uint16) if ids.max() < 1 << 16 else ids))
                n_held += len(ids)
                del ids
                give_back()
                if n_held >= SEGMENT_IDS:
                    flush()
        if stream is not None:
            if held:
                flush()
            stream.close()
            row = [[name], [TaskContext.get().partitionId()], [n_docs], [n_ids], [n_bytes]]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["path", "file_no", "n_docs", "n_ids", "bytes"])

    ordered = src.withColumn("tie_", F.xxhash64("text")).repartitionByRange("doc_id", "tie_").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie_").select("doc_id", "text")
    return scratch(ordered.mapInArrow(tidy(run), "path string, file_no int, n_docs long, n_ids long, bytes long"), "token-files")


def read_tokens(files: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with ``ids`` the ids) of each document in the files that ``files`` lists.

    start counts the ids of all documents before it, over all files in order. A damaged file raises ValueError.
    """
    before = F.sum("n_ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with _open(path, "r") as stream:
                    for docs, values in read_segments(stream):
                        ends = np.cumsum(docs["n"].astype(np.int64))
                        begins = ends - docs["n"]
                        parts = [values[x:y] for x, y in zip(begins, ends)]
                        columns = [
                            pa.array(docs["id"].astype(np.int64), pa.int64(), mask=docs["has"] == 0),
                            pa.array(begins + start),
                            pa.array(docs["n"].astype(np.int64)),
                            pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        ]
                        if ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]), pa.int32()), pa.array(values.view("<i4"))))
                        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
                        del values, parts, columns
                        give_back()
                        start += int(docs["n"].sum())

    return placed.repartition(max(1, files.count())).mapInArrow(tidy(run), schema)
