"""Byte-level BPE as a finite-state transducer.

Compiling. A rank table fixes every token's last merge (``split``) and every
pair's product. A sequence of tokens is the encoding of its bytes exactly when
each neighbouring pair is *stable*: no merge that the ranks put earlier could
have crossed the border. So the encodings form a regular language, and the
non-deterministic transducer reads bytes through the vocabulary's trie and may
close a token wherever the pair with the one before is stable.

Running. The transducer is determinised lazily: a state is the set of live
readings, each a trie node plus the token before it (or any token that allows
the same tokens below that node, which keeps states few). Each prefix of a piece
has one encoding, so a state also names the one token that can end there; the
output is the chain of these tokens up to the last border that all live readings
share, and the lookahead behind it is bounded by the vocabulary. Transitions are
kept as they are first met; the store of states and the memo of pieces are
emptied when they reach a fixed size, so memory is bounded whatever the texts.

Decoding. Tokens' bytes pass through an incremental UTF-8 state machine which
holds back at most three bytes of an unfinished character; bytes that no
character can start or continue with become U+FFFD.

Defined cases: null and empty texts have no tokens; texts are encoded whole,
each match of the pattern separately; special tokens do not exist.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codestrata.llm.arrow import column, kept, map_rows

STATES = 150_000
PIECES = 300_000
SUBTREE = 4
WINDOW = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: lines of base64 bytes and a rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.product: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._last_merge(token, rank)
                if parts:
                    self.split[rank] = parts
                    self.product[parts] = rank
        # The trie: per node the children by byte; per node the token that ends there or -1.
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, rank in ranks.items():
            if len(token) > 1 and rank not in self.split:
                continue  # no merges lead to it
            node = 0
            for byte in token:
                following = self.children[node].get(byte)
                if following is None:
                    following = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = following
            self.token[node] = rank
        self.depth = [0] * len(self.token)
        self.below = [0] * len(self.token)
        for node in range(len(self.token)):  # parents come before their children
            for child in self.children[node].values():
                self.depth[child] = self.depth[node] + 1
        for node in range(len(self.token) - 1, -1, -1):
            self.below[node] = (self.token[node] >= 0) + sum(self.below[c] for c in self.children[node].values())
        self.size = {i: len(t) for t, i in ranks.items()}
        self._like: dict[tuple[int, int], int | None] = {}
        self._same: dict[tuple, int] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._sets: list[tuple[tuple[int, int], ...]] = []
        self._moves: list[dict[int, int]] = []
        self._label: list[int] = []
        self._like.clear()
        self._same.clear()
        self.start = self._state(())

    def _state(self, readings: tuple[tuple[int, int], ...]) -> int:
        found = self._ids.get(readings)
        if found is None:
            found = self._ids[readings] = len(self._sets)
            self._sets.append(readings)
            self._moves.append({})
            # A prefix has one encoding, so at most one reading closes a token here.
            self._label.append(next((t for last, node in readings if (t := self.token[node]) >= 0 and self.stable(last, t)), -1))
        return found

    def _class(self, last: int, node: int) -> int | None:
        """A token that behaves as ``last`` does before every token below ``node``; None if none may follow."""
        if last < 0 or self.below[node] > SUBTREE:
            return last
        found = self._like.get((last, node), 0)
        if found == 0:
            allowed, stack = [], [node]
            n = 0
            while stack:
                at = stack.pop()
                token = self.token[at]
                if token >= 0:
                    n += 1
                    if self.stable(last, token):
                        allowed.append(token)
                stack.extend(self.children[at].values())
            found = None if not allowed else -1 if len(allowed) == n else self._same.setdefault((node, tuple(allowed)), last)
            self._like[last, node] = found
        return found

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``, by running the earlier merges on its bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(rank, -1))
            if best[0] >= rank:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        a, b = (self.ranks.get(x) for x in parts)
        return None if a is None or b is None else (a, b)

    def stable(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: undoing both tokens' merges, latest first, no earlier merge crosses the border."""
        if left < 0:
            return True
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) >= STATES:
                self._stable.clear()
            known = self._stable[left, right] = self._check(left, right)
        return known

    def _check(self, a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            if self.product.get((a, b), limit) < limit:
                return False
            # At equal ranks the left pair merges first, so undo the right token's merge first.
            undo_a, undo_b = a in self.split, b in self.split
            if not undo_a and not undo_b:
                return True
            if undo_a and (not undo_b or a > b):
                limit = a
                a = self.split[a][1]
            else:
                limit = b + 1
                b = self.split[b][0]

    def _move(self, state: int, byte: int) -> int:
        """Determinises one transition: every live reading goes on, and a new one starts after the closed token."""
        following = []
        for last, node in self._sets[state]:
            child = self.children[node].get(byte)
            if child is not None and (kept := self._class(last, child)) is not None:
                following.append((kept, child))
        closed = self._label[state]
        if closed >= 0 or state == self.start:
            child = self.children[0].get(byte)
            if child is not None and (kept := self._class(closed, child)) is not None:
                following.append((kept, child))
        if not following:
            raise ValueError(f"no token holds the byte {byte}")
        move = self._moves[state][byte] = self._state(tuple(following))
        return move

    def _trace(self, labels: list[int], at: int) -> list[int]:
        """The tokens that end at ``at``, first to last."""
        out = []
        size = self.size
        while at > 0:
            token = labels[at]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def _agreed(self, state: int, at: int, labels: list[int]) -> int:
        """The last border that all live readings share; it lies within a bounded distance of ``at``."""
        heads = {at - self.depth[node] for _, node in self._sets[state]}
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(last - self.size[labels[last]])
        return heads.pop()

    def encode(self, piece: bytes) -> list[int]:
        """The piece's token ids. Long pieces are emitted as the readings agree, so only a window is held."""
        if len(self._sets) > STATES:
            self._reset()
        state, moves, label = self.start, self._moves, self._label
        labels = [-1]
        out: list[int] = []
        for byte in piece:
            following = moves[state].get(byte)
            state = following if following is not None else self._move(state, byte)
            labels.append(label[state])
            if len(labels) > WINDOW:
                border = self._agreed(state, len(labels) - 1, labels)
                out += self._trace(labels, border)
                labels = labels[border:]
                labels[0] = -1
                if len(self._sets) > STATES:
                    readings = self._sets[state]
                    self._reset()
                    moves, label = self._moves, self._label
                    state = self._state(readings)
        return out + self._trace(labels, len(labels) - 1)


class Utf8Machine:
    """Incremental UTF-8: ``feed`` returns the characters that are complete, ``close`` the rest."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Codec:
    """Whole texts to ids and back. One per worker and vocabulary; see ``codec``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if len(self.memo) >= PIECES:
            self.memo.clear()
        ids = array("I", self.transducer.encode(piece.encode("utf-8"))).tobytes()
        if len(piece) <= 64:
            self.memo[piece] = ids
        return ids

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, miss = self.memo.get, self._piece
        return b"".join([memo(p) or miss(p) for p in self.pieces.findall(text)])

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """The text, piece by piece; no piece ends inside a character."""
        machine = Utf8Machine()
        run: list[int] = []
        for i in ids:
            run.append(i)
            if len(run) == chunk:
                yield machine.feed(self.decode_bytes(run))
                run = []
        yield machine.feed(self.decode_bytes(run))
        yield machine.close()


def codec(path: str, pattern: str) -> Codec:
    """This process's codec for a rank file: built once a worker, for the stage that encodes."""
    return kept((path, pattern), lambda: Codec(load_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text", ids: bool = True) -> DataFrame:
    """Encodes each row's whole text and decodes the ids again.

    ``path`` is the rank file's place on every executor. Returns per row the id
    column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if ``ids``,
    ``token_ids`` (array<int>); rows are neither merged nor dropped. Nothing is
    shuffled: the scan's partitions are the tasks.
    """
    extra = ", token_ids array<int>" if ids else ""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests, back, lists = [], [], [], []
                for text in column(part, "t").to_pylist():
                    packed = own.encode_packed(text or "")
                    numbers = array("I", packed)
                    counts.append(len(numbers))
                    digests.append(hashlib.sha256(packed).hexdigest())
                    decoded = hashlib.sha256()
                    for run_of_text in own.decode_stream(numbers):
                        decoded.update(run_of_text.encode("utf-8"))
                    back.append(decoded.hexdigest())
                    if ids:
                        lists.append(numbers)
                yield {"i": column(part, "i"), "n_tokens": counts, "ids_sha256": digests, "decoded_sha256": back} | ({"token_ids": lists} if ids else {})

    rows = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"))
    return map_rows(rows, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}", run, keeps=(path, pattern)).withColumnRenamed("i", id_column)
