"""A byte queue with searches that can be taken up again, and separators found across pushes."""

from __future__ import annotations


class ByteFifo:
    """Bytes in, bytes out.  `at` counts the bytes that have left; a search says how far from the
    front it found something, and can start where an earlier one gave up."""

    def __init__(self) -> None:
        self.data = bytearray()
        self.at = 0

    def __len__(self) -> int:
        return len(self.data)

    def push(self, data: bytes) -> None:
        self.data += data

    def peek(self, n: int) -> bytes:
        return bytes(self.data[:n])

    def pop(self, n: int) -> bytes:
        out = self.peek(n)
        self.drop(n)
        return out

    def drop(self, n: int) -> None:
        n = min(n, len(self.data))
        del self.data[:n]
        self.at += n

    def search(self, what: bytes, start: int | None = None) -> int:
        """Places from the front to the first occurrence, -1 if there is none yet.

        start: a position of the stream (bytes that ever came before it) to look from.
        """
        if not what:
            return 0
        return self.data.find(what, max(0, start - self.at) if start is not None else 0)

    def restart(self, what: bytes) -> int:
        """The position from which a failed search for `what` must go on when more has come."""
        return self.at + max(0, len(self.data) - len(what) + 1)

    def split_next(self, separator: bytes, start: int | None = None) -> bytes | None:
        """What stands before the next separator, which goes too; None if there is none yet."""
        k = self.search(separator, start)
        if k < 0:
            return None
        out = self.pop(k)
        self.drop(len(separator))
        return out
