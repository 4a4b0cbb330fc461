"""The lattice of vocabulary pieces over a text: transitions, streaming Viterbi and trie-shared counts.

A path through the lattice is a sequence of pieces that spell the text. Two rules score it:

* "unigram": the sum of the pieces' log probabilities; the best path wins.
* "bpe": for a model of merges, whose scores are merge orders. A step from piece a to piece b scores minus infinity
  unless merging leaves a and b apart when they stand side by side; else it adds b's score. Exactly one path to each
  boundary survives, and it is what merging gives for the text up to there.

Inside, a space stands for the model's space mark. No piece holds a space after another character, so a space
that follows a non-space is a boundary of every path, as is each character outside the vocabulary, which is
spelt in bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

SPACE_MARK = "▁"
SEGMENT = re.compile(" +[^ \n]*|[^ \n]+|\n")
#: What a character outside the vocabulary costs a path.
UNKNOWN = 1e6


class Vocabulary:
    """Pieces of a SentencePiece model file, which the library only reads; the ids of a text are found here."""

    def __init__(self, path: str, rule: str = "bpe"):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rule, self.size = rule, file.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_ids = [0] * 256
        self.id_of: dict[str, int] = {}
        self.score = [0.0] * self.size
        for i in range(self.size):
            piece = file.id_to_piece(i)
            if file.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i)):
                piece = piece.replace(SPACE_MARK, " ")
                self.id_of[piece], self.bytes_of[i], self.score[i] = i, piece.encode(), file.get_score(i)
        self.longest = max(map(len, self.id_of))
        self.parts: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}
        self.rank = [0] * self.size
        if rule == "bpe":
            for r, i in enumerate(sorted(self.id_of.values(), key=lambda i: -self.score[i])):
                self.rank[i] = r
            for piece, i in list(self.id_of.items()):
                if len(piece) > 1:
                    left = self.merge(piece, stop=True)
                    if len(left) == 2:
                        self.parts[i] = (left[0], left[1])
                    else:  # merging never makes this piece
                        del self.id_of[piece]

    def merge(self, text: str, stop: bool = False) -> list[int]:
        """Plain merging of a short text, best score first and leftmost among equals; stop: leave the last merge undone."""
        own = [(c, self.id_of[c]) for c in text]
        while len(own) > 1 + stop:
            best, at = None, -1
            for k in range(len(own) - 1):
                i = self.id_of.get(own[k][0] + own[k + 1][0])
                if i is not None and (best is None or self.score[i] > self.score[best]):
                    best, at = i, k
            if best is None:
                break
            own[at : at + 2] = [(own[at][0] + own[at + 1][0], best)]
        return [i for _, i in own]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b apart. Undoes, step by step, the later of the two last merges beside the boundary."""
        key = a * self.size + b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= 500_000:
                self._apart.clear()
            known = self._apart[key] = self._find_apart(a, b)
        return known

    def _find_apart(self, a: int, b: int) -> bool:
        ta, tb = self.bytes_of[a].decode(), self.bytes_of[b].decode()
        if ta[-1] == " " and tb[0] == " ":  # runs of spaces have equal scores; leftmost goes first
            return self.merge(ta + tb) == [a, b]
        # Times count merges: a boundary piece exists from its own rank until the merge that swallows it.
        until = 1 << 60
        text_a, text_b = ta, tb
        while True:
            joined = self.id_of.get(text_a + text_b)
            if joined is not None and self.rank[joined] < until:
                return False
            ra = self.rank[a] if a in self.parts else -1
            rb = self.rank[b] if b in self.parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, self.parts[a][1]
                text_a = self.bytes_of[a].decode()
            else:  # an equal merge further right comes later
                until, b = rb + 1, self.parts[b][0]
                text_b = self.bytes_of[b].decode()

    def spell(self, char: str) -> list[int]:
        return [self.byte_ids[x] for x in char.encode()]

    def advance(self, text: str, at: int, to: int, base: int, last: list[int], back: list[int], best: list[float]) -> None:
        """The surviving steps into the boundaries after `at`, up to `to`, appended to the lists. For each boundary k from base on,
        these hold at k - base the piece that reaches it (-1: a byte-spelt character), where that piece starts, and the
        path's score."""
        find, longest, score = self.id_of.get, self.longest, self.score
        known, size, apart = self._apart.get, self.size, self.apart
        bpe = self.rule == "bpe"
        for at in range(at + 1, to + 1):
            low = at - longest
            if low < base:
                low = base
            if bpe:
                j = at
                while j > low:
                    j -= 1
                    piece = find(text[j:at])
                    if piece is not None:
                        before = last[j - base]
                        if before < 0:
                            break
                        ok = known(before * size + piece)
                        if ok or (ok is None and apart(before, piece)):
                            break
                else:
                    piece = -1
            else:
                piece, top = -1, 0.0
                for k in range(low, at):
                    own = find(text[k:at])
                    if own is not None and (piece < 0 or best[k - base] + score[own] > top):
                        j, piece, top = k, own, best[k - base] + score[own]
            if piece < 0:
                j = at - 1
            last.append(piece)
            back.append(j)
            best.append(best[j - base] + (score[piece] if piece >= 0 else -UNKNOWN))

    def stream(self, text: str):
        """Yields lists of ids. The window begins at the last boundary that is committed. When it is longer than the longest
        piece, the surviving paths, which end in its last `longest` boundaries, are followed back; if they meet in one
        boundary, the ids up to there are committed. What is left is followed again when it has
        doubled, so that a text without such a boundary takes time in line with its length."""
        base, last, back, best = 0, [-1], [0], [0.0]
        longest, n = self.longest, len(text)
        at, room = 0, longest
        while at < n:
            to = min(n, base + room + 1)
            self.advance(text, at, to, base, last, back, best)
            at = to
            if at - base > room:
                ends = set(range(at - longest + 1, at + 1))
                while len(ends) > 1:
                    far = max(ends)
                    ends.discard(far)
                    ends.add(back[far - base])
                meet = ends.pop()
                if meet > base:
                    yield self._ids(text, base, meet, last, back)
                    del last[: meet - base], back[: meet - base], best[: meet - base]
                    base, room = meet, max(longest, 2 * (at - meet))
                else:
                    room *= 2
        yield self._ids(text, base, n, last, back)

    def _ids(self, text: str, base: int, end: int, last: list[int], back: list[int]) -> list[int]:
        out: list[int] = []
        while end > base:
            piece = last[end - base]
            out += (piece,) if piece >= 0 else self.spell(text[end - 1])[::-1]
            end = back[end - base]
        return out[::-1]


@lru_cache(2)
def vocabulary(path: str, rule: str = "bpe") -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path, rule)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def prepared(text: str) -> str:
    """The text as the lattice sees it: one space in front, a space for each space mark; empty stays empty."""
    return " " + text.replace(SPACE_MARK, " ") if text else ""
