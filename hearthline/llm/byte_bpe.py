"""Byte-level BPE as a finite-state transducer, and streaming decode.

The merges are compiled lazily. A configuration of the transducer is the last token that is settled together with the
bytes read since; reading one more byte either waits or emits the tokens that every continuation agrees on. Equal
configurations are one state, so a transition that is met again is looked up; one that is met once only is computed and
not kept, so that the tables hold what recurs.

Three facts make this exact. A token sequence is the encoding of its bytes if and only if each neighbouring pair of
tokens is the encoding of its own bytes. So the last token of each prefix follows from the last tokens of shorter
prefixes. And a prefix can only stay a boundary of a longer text if some vocabulary entry starts there and reaches past
the bytes read, so waiting is bounded by the longest entry.

Each match of the pattern is encoded on its own; one that is itself a vocabulary entry is that token. Outputs of short
pre-tokens are kept in a table of bounded size, and so are states, within a pre-token too. Texts of narrow scripts are cut
by the same pattern with its classes spelled out, which the standard engine matches faster. Defined results: null and
empty texts have no tokens; rows may repeat; texts and pre-tokens of any length are encoded whole in linear time; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hearthline.llm.common import columns_only, resident, slices, text_bytes

#: Remembered pre-tokens of a generation and the longest one remembered in bytes; states kept before the machine starts anew.
REMEMBERED, SHORT, STATES = 400_000, 64, 300_000
#: Neighbouring tokens whose fit is remembered.
NEIGHBOURS = 200_000
#: Places that tell which moves have been asked for, a power of two.
SEEN = 1 << 21
#: Characters below this one make a text of narrow scripts: Latin, its marks and signs.
NARROW = 0x240


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The encoding by definition: join the neighbouring pair of lowest rank, leftmost first. For short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min(((ranks.get(parts[i] + parts[i + 1], len(ranks) + 1), i) for i in range(len(parts) - 1)), default=(None, 0))
        if best > len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


NEVER = 1 << 62
BYTES = [bytes([b]) for b in range(256)]


class Transducer:
    """Lazily determinised; `encode` walks it over the bytes of one pre-token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.four = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.neighbours: dict[int, bool] = {}
        self.longest = max(map(len, ranks), default=1)
        if self.longest > 255:
            raise ValueError("tokens of more than 255 bytes are not supported")
        self.begins = {t[:k] for t in ranks for k in range(1, len(t))}
        self.edges: dict[bytes, tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]] | None] = {}
        self.reset()

    def reset(self) -> None:
        """A state is the last settled token, the waiting bytes, and the length of the last token of each prefix of them (0 for
        none). It is kept as one string: the number of waiting bytes in two bytes, the lengths, the waiting bytes and the token.

        A move is one number: the next state and the place of what it emits. Tables hold numbers and bytes only, which the
        garbage collector does not visit.
        """
        start = bytes(2)
        self.ids: dict[bytes, int] = {start: 0}
        self.states: list[bytes] = [start]
        self.moves: dict[int, int] = {}
        self.emitted: list[bytes] = [b""]
        self.emitted_at: dict[bytes, int] = {b"": 0}
        self.ends: dict[int, bytes] = {}
        self.seen = bytearray(SEEN)

    def parts(self, state: int) -> tuple[bytes, bytes, bytes]:
        """(last settled token, waiting bytes, lengths) of a state."""
        kept = self.states[state]
        size = kept[0] << 8 | kept[1]
        return kept[2 + 2 * size :], kept[2 + size : 2 + 2 * size], kept[2 : 2 + size]

    def restart(self, state: int) -> int:
        """Forgets all states but the one given, which gets a new number."""
        kept = self.states[state]
        self.reset()
        return self.numbered(kept)

    def numbered(self, kept: bytes) -> int:
        number = self.ids.get(kept)
        if number is None:
            number = self.ids[kept] = len(self.states)
            self.states.append(kept)
        return number

    def growth(self, token: bytes) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]] | None:
        """How the first and the last part grow, as (rank of the merge, part), while `token` is encoded alone; None if it
        does not become one token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        first, last = [(-1, parts[0])], [(-1, parts[-1])]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                first.append((rank, parts[0]))
            if at == len(parts) - 1:
                last.append((rank, parts[-1]))
        first.append((NEVER, b""))
        last.append((NEVER, b""))
        return first, last

    def edge(self, token: bytes) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]] | None:
        if token not in self.edges:
            self.edges[token] = self.growth(token)
        return self.edges[token]

    def fits(self, last: bytes, token: bytes) -> bool:
        """Whether `token` may follow `last` (nothing, at the start): no merge across the boundary comes first.

        Both sides grow in order of rank; a merge across wins when its rank is below the next merge on the left, and not
        above the next one on the right, because the leftmost of equal pairs is merged first.
        """
        right = self.edges.get(token) or self.edge(token)
        if right is None or not last:
            return right is not None
        grown, growing, i, j = (self.edges.get(last) or self.edge(last))[1], right[0], 0, 0
        rank = self.ranks.get
        next_left, next_right = grown[1][0], growing[1][0]
        while True:
            across = rank(grown[i][1] + growing[j][1])
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left <= next_right:
                if next_left == NEVER:
                    return True
                i += 1
                next_left = grown[i + 1][0]
            else:
                j += 1
                next_right = growing[j + 1][0]

    def neighbouring(self, last: bytes, token: bytes) -> bool:
        """`fits`, remembered for pairs of tokens."""
        key = self.ranks[last] << 32 | self.ranks[token] if last else -1 - self.ranks[token]
        found = self.neighbours.get(key)
        if found is None:
            if len(self.neighbours) >= NEIGHBOURS:
                self.neighbours.clear()
            found = self.neighbours[key] = self.fits(last, token)
        return found

    def last_length(self, last: bytes, pending: bytes, lengths: bytes, end: int) -> int:
        """The length of the last token of the encoding of `pending[:end]`, from those of all shorter prefixes; 0 if that
        encoding would cross the settled boundary, where no longer text has a boundary either."""
        for k in range(max(0, end - self.longest), end):
            token = pending[k:end]
            if token in self.ranks and (k == 0 or lengths[k - 1]) and self.neighbouring(pending[k - lengths[k - 1] : k] if k else last, token):
                return end - k
        return 0

    def chain(self, lengths: bytes, end: int) -> list[int]:
        """The boundaries of the encoding that ends at `end`."""
        out = []
        while end:
            out.append(end)
            end -= lengths[end - 1]
        return out[::-1]

    def packed(self, pending: bytes, bounds: list[int]) -> bytes:
        """Ids as little-endian 32-bit integers."""
        four = self.four
        return b"".join([four[pending[a:b]] for a, b in zip([0, *bounds], bounds, strict=False)])

    def advance(self, last: bytes, pending: bytes, lengths: bytes, byte: int) -> tuple[bytes, bytes, bytes, bytes]:
        """Reads a byte: the next configuration, and the ids that are settled now, which are those up to the last boundary that
        lies on the path to every boundary that may live on."""
        pending += BYTES[byte]
        size = len(pending)
        length = self.last_length(last, pending, lengths, size)
        if not length:
            raise ValueError("the vocabulary lacks a byte")
        lengths += BYTES[length]
        cut, begins = size, self.begins
        for k in range(max(0, size - self.longest), size):
            if (k == 0 or lengths[k - 1]) and pending[k:] in begins:
                while cut != k:  # step back the later one until both paths meet
                    if cut > k:
                        cut -= lengths[cut - 1]
                    else:
                        k -= lengths[k - 1]
                if not cut:
                    return last, pending, lengths, b""
        made = self.packed(pending, self.chain(lengths, cut))
        kept = bytearray()
        for end, length in enumerate(lengths[cut:], 1):
            start = end - length
            kept.append(length if length and (start == 0 or start > 0 and kept[start - 1]) else 0)
        return pending[cut - lengths[cut - 1] : cut], pending[cut:], bytes(kept), made

    def learn(self, state: int, byte: int, rest: Iterator[int], out: list[bytes]) -> int:
        """Goes on from a state without a move for the byte, through configurations that need not be states, until one is a
        state or the bytes end (-1). A move is kept when it is asked for a second time or leads to a state."""
        last, pending, lengths = self.parts(state)
        while True:
            last, pending, lengths, made = self.advance(last, pending, lengths, byte)
            if made:
                out.append(made)
            kept = BYTES[len(pending) >> 8] + BYTES[len(pending) & 255] + lengths + pending + last
            target = self.ids.get(kept, -1)
            if state >= 0:
                mark = ((state << 8 | byte) * 0x9E3779B1 >> 7) & (SEEN - 1)
                if target >= 0 or self.seen[mark]:
                    target = self.numbered(kept)
                    place = self.emitted_at.get(made, -1)
                    if place < 0:
                        place = self.emitted_at[made] = len(self.emitted)
                        self.emitted.append(made)
                    self.moves[state << 8 | byte] = target << 32 | place
                else:
                    self.seen[mark] = 1
            state = target
            if state >= 0:
                return state
            following = next(rest, None)
            if following is None:
                out.append(self.packed(pending, self.chain(lengths, len(pending))))
                return -1
            byte = following

    def finish(self, state: int) -> bytes:
        """The ids of the bytes that still wait at the end."""
        _, pending, lengths = self.parts(state)
        found = self.ends[state] = self.packed(pending, self.chain(lengths, len(pending)))
        return found

    def encode(self, piece: bytes) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit integers."""
        whole = self.four.get(piece)
        if whole is not None:
            return whole
        out: list[bytes] = []
        state, rest = 0, iter(piece)
        get, emitted = self.moves.get, self.emitted
        for byte in rest:
            step = get(state << 8 | byte)
            if step is not None:
                state = step >> 32
                if step & 0xFFFFFFFF:
                    out.append(emitted[step & 0xFFFFFFFF])
                continue
            state = self.learn(state, byte, rest, out)
            if state < 0:
                return b"".join(out)
            if len(self.states) > STATES:
                state = self.restart(state)
                get, emitted = self.moves.get, self.emitted
        out.append(self.ends.get(state) or self.finish(state))
        return b"".join(out)


def spelled_out(pattern: str, below: int = NARROW) -> Callable[[str], list[str]] | None:
    """The pattern's findall for texts whose characters are all below a bound, with \\p{L}, \\p{N}, \\s and \\S replaced by the
    characters they match there; None for patterns with other classes or with groups."""
    members = lambda name: "".join(re.escape(chr(c)) for c in range(below) if regex.fullmatch(name, chr(c)))
    out, at, inside = [], 0, False
    while at < len(pattern):
        found = re.match(r"\\p\{[LN]\}|\\[sS]", pattern[at:])
        if found:
            name = found[0]
            if name == r"\S" and inside:
                return None
            out.append(members(name) if inside else f"[^{members(chr(92) + 's')}]" if name == r"\S" else f"[{members(name)}]")
            at += len(name)
            continue
        if pattern[at] == "\\":
            return None
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    made = re.compile("".join(out))
    return None if made.groups else made.findall


class Encoder(dict):
    """From each pre-token to its ids as little-endian 32-bit integers. Short ones are remembered in two generations: a full
    one becomes the older, from which entries in use move back, so common pre-tokens stay and memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.machine = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.find_narrow = spelled_out(pattern)
        self.narrow = re.compile(f"[\\0-{chr(NARROW - 1)}]*").fullmatch
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = self.machine.encode(raw)
            if len(raw) > SHORT:
                return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        find = self.find_narrow if self.find_narrow and self.narrow(text) else self.find
        return b"".join(map(self.__getitem__, find(text)))


class Utf8Stream:
    """Incremental UTF-8: bytes go in as they are decoded, whole characters come out, at most three bytes wait.

    The state is the bytes of an unfinished character; malformed bytes become U+FFFD, as the standard decoder does.
    """

    def __init__(self) -> None:
        self.wait = b""

    #: Lead byte: its length and the range of its second byte.
    LEADS = ((0xC2, 0xDF, 2, 0x80, 0xBF), (0xE0, 0xE0, 3, 0xA0, 0xBF), (0xE1, 0xEC, 3, 0x80, 0xBF), (0xED, 0xED, 3, 0x80, 0x9F), (0xEE, 0xEF, 3, 0x80, 0xBF), (0xF0, 0xF0, 4, 0x90, 0xBF), (0xF1, 0xF3, 4, 0x80, 0xBF), (0xF4, 0xF4, 4, 0x80, 0x8F))

    def unfinished(self, data: bytes) -> int:
        """How many bytes at the end may still become a character."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            for low, high, size, second_low, second_high in self.LEADS:
                if low <= lead <= high and back < size and (back == 1 or second_low <= data[-back + 1] <= second_high):
                    return back
            return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.wait + data
        held = self.unfinished(data)
        self.wait = data[len(data) - held :]
        return data[: len(data) - held].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.wait = self.wait, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def stream(self, ids: np.ndarray, run: int = 65_536) -> Iterator[str]:
        """The text of the ids in pieces, a bounded run of ids at a time."""
        state, get = Utf8Stream(), self.bytes.__getitem__
        for at in range(0, len(ids), run):
            yield state.feed(b"".join(map(get, ids[at : at + run].tolist())))
        yield state.close()


def coder(file: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Compiled once per Python worker, until another operator works there; the rank file is part of the installation on
    every machine."""

    def build() -> tuple[Encoder, Decoder]:
        ranks = read_ranks(file)
        return Encoder(ranks, pattern), Decoder(ranks)

    return resident(("byte_bpe", file, pattern), build)


def encode_texts(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, round_trip) for each row; `round_trip` tells that decoding the ids gives the text.
    One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(file, pattern)
        for batch in batches:
            for keys, texts in _rows(batch):
                ids = [encoder.encode(t) for t in texts]
                same = ["".join(decoder.stream(np.frombuffer(x, dtype="<u4"))) == t for x, t in zip(ids, texts, strict=True)]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns_only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, round_trip boolean")


def digest_texts(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of `encode_texts`, without moving ids out of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(file, pattern)
        for batch in batches:
            for keys, texts in _rows(batch):
                n, ids_digest, text_digest = [], [], []
                for text in texts:
                    ids = encoder.encode(text)
                    n.append(len(ids) // 4)
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    whole = hashlib.sha256()
                    for piece in decoder.stream(np.frombuffer(ids, dtype="<u4")):
                        whole.update(piece.encode())
                    text_digest.append(whole.hexdigest())
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns_only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _rows(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[pa.Array, Iterator[str]]]:
    """Keys and texts of runs of rows of bounded size."""
    data, offsets = text_bytes(batch.column(1))
    for first, end in slices(offsets, most):
        yield batch.column(0).slice(first, end - first), [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(first, end)]
