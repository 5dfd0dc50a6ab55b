"""Operators for training data: top items per group, tokens, source mixing, text repair, personal data, abusive content."""

from collections.abc import Iterator

#: Texts are worked on in portions of about so many characters, so that a batch of long texts needs no more memory.
PORTION = 2_000_000


def portions(texts: list, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive portions of a list of texts; a single long text is a portion of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Remembered(dict):
    """Results by text, forgotten all at once when the texts kept make up more than ``most`` characters."""

    def __init__(self, most: int):
        super().__init__()
        self.most = self.left = most

    def keep(self, key: str, value, size: int) -> None:
        self.left -= size + 50
        if self.left < 0:
            self.clear()
            self.left = self.most - size
        self[key] = value
