"""SentencePiece encoding and decoding with byte spans, from a model file, without the library.

The text is normalised by longest-prefix matches in the model's compiled character map (a double-array trie), and
each normalised byte keeps the source byte it came from. Merges then run on the normalised text, and every piece is
projected through that alignment to a span of bytes of the original text. Where no piece can hold a word mark after
another character, the text is cut before each run of marks, the parts are encoded alone, and their results are kept
in a bounded cache, as merges never cross such a cut.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, small_batches

MARK = "▁"
#: piece types of a model file (fixed values)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: parts kept in a worker's cache; when full it stays as it is, since the frequent parts came first
CACHE_PARTS = 600_000
NEVER = float("-inf")


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""

    def varint(i):
        shift = value = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, i
            shift += 7

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """Double-array trie from source prefixes to replacements, as compiled into a model."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest source prefix at `at`."""
        units, found = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if (unit & ((1 << 31) | 0xFF)) != byte:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                start = units[node] & ((1 << 31) - 1)
                found = self.texts[start : self.texts.index(b"\0", start)], i + 1 - at
        return found


class Codec:
    """Encoder and decoder of one byte-pair model file."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        charsmap, self.dummy, self.trim, self.escape = b"", True, True, True
        algorithm = 1
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.types.append(kind)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        algorithm = v
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy = bool(v)
                    elif n == 4:
                        self.trim = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if algorithm != 2 or USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("only byte-pair models without user-defined or unused pieces can be read")
        self.map = CharacterMap(charsmap) if charsmap else None
        self.score = {p: s for p, s, t in zip(self.pieces, scores, self.types) if t == NORMAL}
        self.id = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.unknown = self.types.index(UNKNOWN)
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if self.types[i] == BYTE}
        self.value = {i: v for v, i in self.byte.items()}
        self.width = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types)], np.int32)
        # what an id stands for where no id of `special` is near: a byte below 128 is a character by itself
        self.plain = [chr(self.value[i]) if i in self.value else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.decimal = list(map(str, range(len(self.pieces))))
        self.special = frozenset(i for i, t in enumerate(self.types) if t != NORMAL and self.value.get(i, 128) > 127)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.part = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.cache: dict[str, bytes] = {}

    # normalisation ------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text, and for each of its bytes, and its end, the source byte; None if only marks were put in."""
        if self.map is None and not self.trim:
            if not text:
                return "", None
            text = text.replace(" ", MARK) if self.escape else text
            return (MARK if self.escape else " ") + text if self.dummy else text, None
        data, out, source, at = text.encode(), bytearray(), [], 0
        mark = MARK.encode() if self.escape else b" "
        steps = []
        while at < len(data):
            found = self.map.longest(data, at) if self.map else None
            if found is None:
                n = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                found = data[at : at + n], n
            steps.append((found[0], at))
            at += found[1]
        end = len(data)
        if self.trim:
            while steps and not steps[0][0].strip(b" "):
                steps.pop(0)
            while steps and not steps[-1][0].strip(b" "):
                end = steps.pop()[1]
        if steps and self.dummy:
            out += mark
            source += [steps[0][1]] * len(mark)
        space = self.trim
        for piece, at in steps:
            if self.trim and space:
                piece = piece.lstrip(b" ")
            for byte in piece:
                new = mark if byte == 32 else bytes([byte])
                out += new
                source += [at] * len(new)
            if piece:
                space = piece[-1] == 32
        if self.trim:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = source[len(out)]
                del source[len(out) :]
        return out.decode(), [*source, end]

    # merges -------------------------------------------------------------------------------------------------------

    def merge(self, part: str) -> list[str]:
        """Pieces of one part: the best-scored neighbours merge first, the leftmost of equals."""
        score = self.score
        if len(part) == 1:
            return [part]
        symbols = list(part)
        if len(symbols) > 48:
            return self._merge_long(symbols)
        get = score.get
        ranks = [get(a + b, NEVER) for a, b in zip(symbols, part[1:])]
        best = max(ranks)
        while best != NEVER:
            at = ranks.index(best)
            new = symbols[at] + symbols.pop(at + 1)
            symbols[at] = new
            del ranks[at]
            if not ranks:
                break
            if at:
                ranks[at - 1] = get(symbols[at - 1] + new, NEVER)
            if at < len(ranks):
                ranks[at] = get(new + symbols[at + 1], NEVER)
            best = max(ranks)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        score, n = self.score, len(symbols)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i, j):
            if i >= 0 and j < n:
                new = symbols[i] + symbols[j]
                s = score.get(new)
                if s is not None:
                    heapq.heappush(heap, (-s, i, j, len(new)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size or after[i] != j:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def _ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]

    def parts(self, normalised: str) -> list[str]:
        if not normalised:
            return []
        return self.part.findall(normalised) if self.cuts else [normalised]

    # interface ----------------------------------------------------------------------------------------------------

    def encode(self, text: str | None) -> list[int]:
        normalised, _ = self.normalise(text or "")
        return [i for part in self.parts(normalised) for piece in self.merge(part) for i in self._ids(piece)]

    def encode_spans(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the first byte and the byte behind the last one of the original text for each id.

        A mark put in front of the text has an empty span; a piece of bytes of one character splits its span.
        """
        text = text or ""
        normalised, source = self.normalise(text)
        if source is None:
            source, at = [], 0
            data = normalised.encode()
            marks = len(MARK.encode()) if self.escape else 1
            original = text.encode()
            i = 0
            if data and self.dummy:
                source += [0] * marks
                i = marks
            while i < len(data):
                if original[at] == 32 and self.escape:
                    source += [at] * marks
                    i += marks
                else:
                    source.append(at)
                    i += 1
                at += 1
            source.append(len(original))
        ids, begins, ends, at = [], [], [], 0
        for part in self.parts(normalised):
            for piece in self.merge(part):
                new, size = self._ids(piece), len(piece.encode())
                widths = [size] if len(new) == 1 else [1] * size
                for i, width in zip(new, widths):
                    ids.append(i)
                    begins.append(source[at])
                    ends.append(source[at + width])
                    at += width
        return ids, begins, ends

    def decode(self, ids: list[int]) -> str:
        """Text of ids. A mark in front is dropped if the model puts one there; with trimming, one of each piece in front."""
        out, lead = [], 0
        if self.special.isdisjoint(ids):  # no byte that needs others, no control and no unknown pieces
            while (self.dummy or self.trim) and lead < len(ids) and self.pieces[ids[lead]].startswith(MARK):
                out.append(self.plain[ids[lead]][1:])
                lead += 1
                if out[-1] or not self.trim:
                    break
            return "".join(out) + "".join([self.plain[i] for i in ids[lead:]])
        run, front, seen = bytearray(), True, False
        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                run.append(self.value[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            front = front and not seen and not any(out)
            seen = False
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.pieces[i]
            if front and kind != UNKNOWN and (self.dummy or self.trim) and piece.startswith(MARK):
                piece, seen = piece[1:], not self.trim
            out.append(piece.replace(MARK, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def _part_ids(self, part: str) -> bytes:
        """Ids of a part as int32; they don't depend on where the part stands, so they are cached for all texts."""
        ids, known = [], self.id
        for piece in self.merge(part):
            i = known.get(piece)
            if i is None:
                ids += self._ids(piece)
            else:
                ids.append(i)
        out = array("i", ids).tobytes()
        if len(part) <= 64 and len(self.cache) < CACHE_PARTS:
            self.cache[part] = out
        return out

    def _text_ids(self, parts: list[str]) -> np.ndarray:
        got = list(map(self.cache.get, parts))
        if None in got:
            new: dict[str, bytes] = {}
            for at, part in enumerate(parts):
                if got[at] is None:
                    out = new.get(part)
                    if out is None:
                        out = new[part] = self._part_ids(part)
                    got[at] = out
        return np.frombuffer(b"".join(got), np.int32)

    def _source(self, text: str, normalised: str, source: list[int] | None) -> np.ndarray:
        """The source byte of each byte of the normalised text, and of its end."""
        if source is not None:
            return np.array(source, np.int32)
        original = np.frombuffer(text.encode(), np.uint8)
        marks = len(MARK.encode()) if self.escape else 1
        at = np.arange(len(original), dtype=np.int32)
        at = np.repeat(at, np.where(original == 32, marks, 1)) if self.escape else at
        front = np.zeros(marks if normalised and self.dummy else 0, np.int32)
        return np.concatenate([front, at, np.array([len(original)], np.int32)])

    def encode_digest(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, str, str]:
        """Ids, begins and ends as encode_spans() has them, their number, and the digests of ids and decoded text.

        All come from the same parts: the digests are of the very ids that are projected to spans.
        """
        text = text or ""
        normalised, source = self.normalise(text)
        parts = self.parts(normalised)
        ids = self._text_ids(parts)
        each = ids.tolist()
        decoded = self.decode(each)
        decimal = ",".join([self.decimal[i] for i in each])
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (decimal, decoded)]
        widths = self.width[ids]
        if self.unknown in ids:  # an unknown piece is as wide as it is in the text
            widths = np.array([w for part in parts for piece in self.merge(part) for w in self._widths(piece)], np.int32)
        source, stop = self._source(text, normalised, source), np.cumsum(widths)
        return (ids, source[stop - widths], source[stop], len(ids), *digests)

    def _widths(self, piece: str) -> list[int]:
        size = len(piece.encode())
        return [size] if len(self._ids(piece)) == 1 else [1] * size


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that belongs to no character becomes U+FFFD, one by one."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends) for every row of docs(doc_id, text); null and empty texts give empty arrays.

    One map over the rows, without a shuffle: repeated rows give repeated results, an empty table none, and other
    columns are not read.
    """

    def run(batches):
        c = codec(model or default_model())
        for batch in batches:
            rows = [c.encode_digest(t.as_py()) for t in batch.column("text")]
            cols = [batch.column("doc_id")] + [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "begins", "ends"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def digest_documents(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, begins, ends) for every row of docs(doc_id, text), null as empty.

    One map without a shuffle: long texts are encoded whole, repeated rows give repeated results, an empty table gives
    none, and other columns are not read. begins and ends are the spans of original bytes of the ids; with_ids adds the ids themselves as an array `ids`.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, "begins", "ends"]

    def run(batches):
        c = codec(model or default_model())
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [c.encode_digest(t.as_py()) for t in batch.column("text")]
                cols = [batch.column("doc_id"), pa.array([r[3] for r in rows], pa.int64())]
                cols += [pa.array([r[k] for r in rows], pa.string()) for k in (4, 5)]
                cols += [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(0 if with_ids else 1, 3)]
                yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", begins array<int>, ends array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids of every document and their spans, with their number and digests.

    Null and empty texts have no ids; repeated rows stay; an empty table gives none.
    """
    return digest_documents(docs, with_ids=True)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document, and the spans of original bytes of its ids."""
    return digest_documents(documents(spark, sf_dir))
