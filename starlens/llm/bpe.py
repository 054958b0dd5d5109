"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Two facts make left-to-right encoding exact.  A sequence of tokens is what the merges give for its bytes
if and only if that holds for each two neighbours; and exactly one token can end each prefix.  So the
transducer reads bytes and writes, for every prefix, the token that ends it.  Its state is, for every place
where a longer token may have begun, the place in the trie of tokens and the token that ends there; states and
transitions are made when first met.  Tokens on which all open places agree are settled and leave the
transducer, after every ``AHEAD`` bytes and at the end (places are open for the longest token at most).

Decoding turns ids into text one id at a time: a state machine over UTF-8 bytes remembers an unfinished
character, so that a stream can be cut between any two ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from starlens.llm.common import by_value, texts_of

by_value(__name__)

#: What a Python worker holds at most: pieces in each of two generations of the memo (about 200 bytes each),
#: and states of the transducer with their steps (about 600 bytes each), which begins anew beyond them.
MEMO = 150_000
STATES = 80_000
#: Bytes read before settled tokens are written out.
AHEAD = 4096
#: Bits of a token's id, where a number holds it beside another one.
ID_BITS = 24


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a file of base64 tokens and ranks (a vocabulary of fixed size)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


#: Parts at the left and at the right edge of a token, each with the rank of the merge that ends it.
Edges = tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]


class Transducer:
    """Encodes one piece of text (bytes) at a time."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.trie: list[dict[int, int]] = [{}]
        self.at_node: list[int] = [-1]
        self.depth = [0]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                if byte not in self.trie[node]:
                    self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.at_node.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.trie[node][byte]
            self.at_node[node] = rank
        self.edges: dict[int, Edges | None] = {}
        self._restart()

    def _restart(self) -> None:
        #: Places of a state, oldest first: trie node << ID_BITS | 1 + id of the token that ends there (0: none).
        self.states: list[tuple[int, ...]] = [(0,)]
        self.numbers = {(0,): 0}
        #: state number << 8 | byte -> next state's number << ID_BITS | id of the token that ends here
        self.steps: dict[int, int] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition, used on two tokens at a time."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, len(self.tokens)) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == len(self.tokens):
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> Edges | None:
        """The parts at the two edges of a token while its bytes are merged, each with the rank that ends it.

        ``([], [])`` if merging doesn't give the token; None if a merge enables one of lower rank (then
        ranks don't tell the order of merges).
        """
        data, never = self.tokens[token], len(self.tokens)
        parts = [data[i : i + 1] for i in range(len(data))]
        first, last, before = [], [], -1
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, never) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == never:
                return [], []
            if best < before:
                return None if self.merge(data) == [token] else ([], [])
            before, i = best, joined.index(best)
            if i == 0:
                first.append((parts[0], best))
            if i == len(parts) - 2:
                last.append((parts[-1], best))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [*first, (data, never)], [*last, (data, never)]

    def _may_end(self, last: int, token: int) -> bool:
        """Whether merging the bytes of ``last`` and ``token`` (or of ``token`` alone) gives just these."""
        edges = self.edges
        if token not in edges:
            edges[token] = self._edges(token)
        right = edges[token]
        if right is not None and not right[0]:
            return False
        if last < 0:
            return True
        left = edges[last]
        if left is None or right is None:
            return self.merge(self.tokens[last] + self.tokens[token]) == [last, token]
        # Both sides merge by rising rank, the left one first on ties, until a merge crosses the middle.
        lasts, firsts = iter(left[1]), iter(right[0])
        (a, a_ends), (b, b_ends) = next(lasts), next(firsts)
        never, get = len(self.tokens), self.ranks.get
        while True:
            rank = get(a + b, never)
            if rank < a_ends and rank <= b_ends:
                return False
            if a_ends <= b_ends:
                if a_ends == never:
                    return True
                a, a_ends = next(lasts)
            else:
                b, b_ends = next(firsts)

    def _step(self, number: int, byte: int) -> int:
        trie, at_node, low = self.trie, self.at_node, (1 << ID_BITS) - 1
        after, chosen = [], -1
        for place in self.states[number]:
            child = trie[place >> ID_BITS].get(byte)
            if child is None:
                continue
            if chosen < 0 <= at_node[child] and self._may_end((place & low) - 1, at_node[child]):
                chosen = at_node[child]
            if trie[child]:
                after.append(child << ID_BITS | place & low)
        after.append(chosen + 1)
        state = tuple(after)
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        step = self.steps[number << 8 | byte] = target << ID_BITS | chosen
        return step

    def _chain(self, ends: list[int], to: int) -> list[int]:
        """The tokens that end at byte ``to``, read backwards from the token that ends each prefix."""
        out = []
        while to:
            out.append(ends[to - 1])
            to -= len(self.tokens[out[-1]])
        return out[::-1]

    def _settled(self, ends: list[int], state: int) -> int:
        """Up to which byte the tokens are the same whichever open place goes on."""
        common = None
        for place in self.states[state]:
            to, cuts = len(ends) - self.depth[place >> ID_BITS], []
            while to:
                cuts.append(to)
                to -= len(self.tokens[ends[to - 1]])
            common = set(cuts) if common is None else common.intersection(cuts)
        return max(common, default=0)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self._restart()
        out: list[int] = []
        ends: list[int] = []
        state, known, low = 0, self.steps.get, (1 << ID_BITS) - 1
        for byte in piece:
            step = known(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            state = step >> ID_BITS
            ends.append(step & low)
            if len(ends) >= AHEAD and not len(ends) % AHEAD:
                to = self._settled(ends, state)
                out += self._chain(ends, to)
                del ends[:to]
        return out + self._chain(ends, len(ends))


class Decoder:
    """Ids to text, one at a time: ``state`` holds the bytes of an unfinished character (at most three).

    Bytes that cannot begin or go on with a character become U+FFFD, as in Python's "replace".
    """

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.memo: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.state = b""

    @staticmethod
    def _advance(state: bytes, data: bytes) -> tuple[str, bytes]:
        """The state machine: needed continuation bytes and the range allowed for the next one."""
        out: list[str] = []
        held = bytearray()
        need, low, high = 0, 0x80, 0xBF
        for byte in state + data:
            if need:
                if low <= byte <= high:
                    held.append(byte)
                    need, low, high = need - 1, 0x80, 0xBF
                    if not need:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("�")
                held.clear()
                need, low, high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                need = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                held.append(byte)
            else:
                out.append("�")
        return "".join(out), bytes(held)

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        state, memo = self.state, self.memo
        for i in ids:
            step = memo[state].get(i)
            if step is None:
                step = memo[state][i] = self._advance(state, self.tokens[i])
                memo.setdefault(step[1], {})
            out.append(step[0])
            state = step[1]
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        """Ends the stream; an unfinished character becomes U+FFFD."""
        rest, self.state = "�" if self.state else "", b""
        return rest


class Memo(dict):
    """Piece -> its ids as text, by the transducer when first met; the decoder's answer is compared with the piece.

    Two generations of at most ``MEMO`` pieces: the older one is dropped when the younger is full, and what
    is still in use moves on.  A piece is whole characters, so the decoder's state is empty on either side of it.
    ``changed`` holds what the decoder gave for pieces that it didn't give back as they were.
    """

    def __init__(self, tokens: list[bytes]) -> None:
        super().__init__()
        self.transducer, self.decoder = Transducer(tokens), Decoder(tokens)
        self.older: dict[str, str] = {}
        self.changed: dict[str, str] = {}
        self.digits = [str(i) for i in range(len(tokens))]

    def __missing__(self, piece: str) -> str:
        known = self.older.get(piece)
        if known is None:
            ids = self.transducer.encode(piece.encode())
            back = self.decoder.feed(ids) + self.decoder.finish()
            if back != piece:
                self.changed[piece] = back
            known = " ".join([self.digits[i] for i in ids])
        if len(piece) < 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = known
        return known


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids`` if asked for).

    Every match of ``pattern`` in the whole text is encoded by itself with the ranks of the file
    ``vocabulary`` (read by the driver; special tokens are ordinary text), and the ids are decoded again.
    Null is encoded as the empty text: no ids.  Repeated rows each get their row, an empty table gives none.
    One long piece is encoded in one left-to-right pass.
    """
    docs = texts_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast({"tokens": read_ranks(vocabulary)})

    def kernel(batches):
        import regex

        # A worker keeps its copy of a broadcast value from task to task, and with it what the coder has learnt.
        held = shared.value
        if "memo" not in held:
            held["memo"] = Memo(held["tokens"])
        memo, find = held["memo"], regex.compile(pattern).findall
        for batch in batches:
            counts, ids_sha, text_sha, lists = [], [], [], []
            for text in batch.column("text"):
                pieces = find(text.as_py() or "")
                digits = " ".join(map(memo.__getitem__, pieces))
                decoded = "".join([memo.changed.get(p, p) for p in pieces] if memo.changed else pieces)
                counts.append(digits.count(" ") + 1 if pieces else 0)
                ids_sha.append(hashlib.sha256(digits.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                lists.append([int(i) for i in digits.split()] if with_ids else None)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(kernel, schema + (", ids array<int>" if with_ids else ""))
