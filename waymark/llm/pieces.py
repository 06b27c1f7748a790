"""Texts cut into pieces that tokenizers of byte-level BPE treat independently.

Such tokenizers let a token begin with one blank, but never let it run across a blank into the next
word. A text is cut before every single blank that stands between two characters that aren't white
space; encoding the pieces one by one and joining the ids equals encoding the text. Runs of white
space stay inside one piece with what surrounds them.
"""

from __future__ import annotations

#: White space other than the blank.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def careful(text: str) -> list[str]:
    out: list[str] = []
    for part in text.split(" "):
        # A part that is empty or begins with white space, or follows one that is empty or ends with it, continues a run.
        if out and (not part or part[0].isspace() or not out[-1] or out[-1][-1].isspace()):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def cut(text: str) -> list[str]:
    """The pieces, all but the first without their leading blank: " ".join(cut(text)) is the text."""
    if "  " in text or text[:1] == " " or text[-1:] == " " or any(c in text and (c + " " in text or " " + c in text) for c in _SPACES):
        return careful(text)
    return text.split(" ")


class PieceCache:
    """Encodes texts piece by piece; make(list of new pieces) gives each one's value.

    Two generations of limit entries at most: a piece met again moves to the young one, and when that
    is full the old one is forgotten.
    """

    def __init__(self, make, limit: int = 100_000):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def __call__(self, texts: list[str | None]) -> list[list]:
        """For each text (None: empty) the values of its pieces in order."""
        split = [cut(t) if t else [] for t in texts]
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = [list(map(young.get, parts)) for parts in split]
        gaps = [[i for i, v in enumerate(values) if v is None] if None in values else () for values in found]
        missing = {parts[i] for parts, at in zip(split, gaps) for i in at}
        seen = missing.intersection(old)
        young.update((p, old[p]) for p in seen)
        new = list(missing - seen)
        young.update(zip(new, self.make([" " + p for p in new])))
        for parts, values, at in zip(split, found, gaps):
            for i in at:
                values[i] = young[parts[i]]
        firsts = list({parts[0] for parts in split if parts})  # without a blank
        value = dict(zip(firsts, self.make(firsts)))
        for parts, values in zip(split, found):
            if parts:
                values[0] = value[parts[0]]
        return found


def chunks_of(texts: list, size: int = 1_000_000):
    """Slices of the list with about size characters, one text at least."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]
