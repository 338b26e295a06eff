"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse as a byte-to-text state machine.

A text is first cut into pieces by the tokenizer's public pattern; merges never cross pieces. Inside a piece the transducer
reads byte by byte and keeps, for each byte end, the last token of the encoding of the prefix ending there. That token is
unique: of the tokens ending at the byte it is the one that stays separate from the last token before it when the two are
merged by the full merge list. Following the links back from every end that can still be extended gives one common path;
its tokens can't change any more and are emitted. Only the ends within the longest token length of the read position can be
extended, so the buffer holds no more than the sufficient lookahead, however long the piece.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import regex


class ByteBpe:
    """A rank file (`<base64 token> <rank>` per line; ranks are ids and merge priorities) as a streaming encoder.

    path: rank file; pattern: how text is cut into pieces (None: the package's public one); cache: most pieces remembered.
    Null and empty texts encode to an empty list. No special tokens: their names in a text are ordinary text.
    """

    def __init__(self, path: str, pattern: str | None = None, cache: int = 1 << 17):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.pieces = regex.compile(pattern)
        self.bytes = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.ends = {t[-2:] for t in self.ids if len(t) > 1}
        self.cache_size = cache
        self._cache: dict[str, list[int]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    @functools.cached_property
    def lookahead(self) -> int:
        """Bytes after which an emitted token is surely stable, from the merge list.

        A later byte changes an earlier token only through a chain of merges of falling rank, each taking away the right
        part of the one before. The longest such chain, found in one pass over the merges in rank order, times the
        longest token bounds how far back a change can reach.
        """
        best: dict[bytes, int] = {}
        deepest = 0
        for token, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(token) < 2:
                continue
            left, right = self._merge(token, rank)
            depth = 1 + best.get(right, 0)
            best[left] = max(best.get(left, 0), depth)
            deepest = max(deepest, depth)
        return (deepest + 1) * self.longest

    def _merge(self, token: bytes, below: int) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes `token`: what is left of it under merges of lower rank."""
        parts = self._reduce(token, below)
        return (parts[0], b"".join(parts[1:])) if len(parts) > 1 else (token[:1], token[1:])

    def _reduce(self, data: bytes, below: int | None = None) -> list[bytes]:
        """The plain merge loop on a short string: always the merge of the lowest rank first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62 or (below is not None and rank >= below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_whole(self, token: int) -> bool:
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = len(self._reduce(self.bytes[token])) == 1
        return got

    def _stay_apart(self, a: int, b: int) -> bool:
        key = (a, b)
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) > 1 << 20:
                self._apart.clear()
            x, y = self.bytes[a], self.bytes[b]
            got = self._apart[key] = self._reduce(x + y) == [x, y]
        return got

    def stream(self, chunks) -> Iterator[int]:
        """Token ids of one piece given as byte chunks, each emitted as soon as it is stable; constant memory.

        A token is stable once all encodings that may still come share it. That is looked at whenever the buffer has
        grown by the longest token; once it holds more than the lookahead computed from the merge list, what lies further
        back than that is stable without looking, so the buffer never exceeds that bound.
        """
        buf = b""  # bytes after the last emitted token
        last: list[tuple[int, int]] = []  # for each end in buf: its last token and where that starts
        before = -1  # the last emitted token
        looked = 0
        for chunk in chunks:
            for byte in chunk:
                buf += bytes((byte,))
                n = len(buf)
                for size in range(min(self.longest, n), 0, -1):
                    token = self.ids.get(buf[n - size :])
                    if token is None or not self._is_whole(token):
                        continue
                    start = n - size
                    prev = last[start - 1][0] if start else before
                    if prev < 0 or self._stay_apart(prev, token):
                        last.append((token, start))
                        break
                else:
                    raise ValueError("the rank file has no token for a byte")
                if n - looked > 2 * self.longest:
                    looked = n
                    path = self._common(last)
                    if not path and n > self.lookahead + 2 * self.longest:
                        path = [x for x in self._back(last, n) if x[1] <= n - self.lookahead]
                    if path:
                        looked = 0
                        cutoff = 0
                        for token, end in path:
                            yield token
                            before, cutoff = token, end
                        buf = buf[cutoff:]
                        last = [(t, s - cutoff) for t, s in last[cutoff:]]
        yield from (t for t, _ in self._back(last, len(last)))

    def _back(self, last, end: int) -> list[tuple[int, int]]:
        path = []
        while end > 0:
            token, start = last[end - 1]
            path.append((token, end))
            end = start
        return path[::-1]

    def _common(self, last) -> list[tuple[int, int]]:
        """The tokens shared by the encodings of all prefixes that may still grow."""
        paths = [self._back(last, e) for e in range(max(1, len(last) - self.longest + 1), len(last) + 1)]
        shared = paths[0]
        for p in paths[1:]:
            k = 0
            while k < min(len(shared), len(p)) and shared[k] == p[k]:
                k += 1
            shared = shared[:k]
            if not shared:
                break
        return shared

    def piece(self, text: str) -> list[int]:
        got = self._cache.get(text)
        if got is None:
            data = text.encode("utf-8", "surrogatepass")
            token = self.ids.get(data)
            if token is not None and self._is_whole(token):
                got = [token]
            else:
                got = list(self.stream((data,)))
            if len(self._cache) >= self.cache_size:
                self._cache.clear()
            if len(text) <= 64:
                self._cache[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            cache, piece = self._cache, self.piece
            for found in self.pieces.finditer(text):  # piece by piece, so that a long text has none of them at once
                m = found[0]
                out += cache.get(m) or piece(m)
        return out

    def decoder(self) -> IncrementalDecoder:
        return IncrementalDecoder(self.bytes)


class IncrementalDecoder:
    """Ids to text, token by token: holds back only the bytes of an unfinished character (three at most)."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.need, self.held = tokens, 0, b""

    def feed(self, token: int) -> str:
        out = []
        for byte in self.tokens[token]:
            if self.need:
                self.held += bytes((byte,))
                self.need -= 1
                if not self.need:
                    out.append(self.held.decode("utf-8", "replace"))
                    self.held = b""
            elif byte < 0x80:
                out.append(chr(byte))
            else:
                self.held = bytes((byte,))
                self.need = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
        return "".join(out)

    def close(self) -> str:
        """What is left, as a replacement character if a character broke off."""
        rest, self.held, self.need = self.held, b"", 0
        return "�" if rest else ""


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One encoder for each rank file and worker process."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
