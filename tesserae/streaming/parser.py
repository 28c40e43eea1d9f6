"""An incremental parser of terminal input, and the same over a stream of rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.terminal import Sequence
from ..plans.sequences import KEYS, VT220

_NAMED = ("primary_device_attributes", "cell_size_px", "text_area_size_px", "text_area_size_cells")
#: What terminals send: replies, the default colours among them, and keys.
REPLIES = (
    *(Sequence(*row) for row in VT220 if row[0] in _NAMED),
    Sequence("cursor_position", "\x1b[%1;%2R", 2, "pos"),
    Sequence("default_fg", "\x1b]10;rgb:%1/%2/%3\x1b\\", 3, "u16hex"),
    Sequence("default_bg", "\x1b]11;rgb:%1/%2/%3\x1b\\", 3, "u16hex"),
    *(Sequence(*row) for row in KEYS if row[1][0] == "\x1b"),
)
Event = tuple[str, str | None, str | None, list[int]]  # kind, character, sequence, arguments


class Parser:
    """Bytes in, events out.  A sequence that could still go on is kept; an invalid byte is skipped."""

    def __init__(self, sequences: tuple[Sequence, ...] = REPLIES, held: bytes = b""):
        self.sequences, self.held, self.ended = sequences, held, False

    def push(self, data: bytes, end: bool = False) -> Iterator[Event]:
        self.held += data
        while self.held:
            text = self.held.decode("latin-1")
            best, waits = None, False
            if text[0] == "\x1b":
                for s in self.sequences:
                    state, args, used = s.parse(text)
                    waits |= state == "again"
                    if state == "success" and (best is None or used > best[2]):
                        best = (s.name, args, used)
            if best:
                self.held = self.held[best[2] :]
                yield "seq", None, best[0], best[1]
            elif waits and not end:
                return
            else:
                size = 1 if self.held[0] < 0x80 else 2 if self.held[0] >> 5 == 6 else 3 if self.held[0] >> 4 == 14 else 4 if self.held[0] >> 3 == 30 else 0
                if size > len(self.held) and not end:
                    return
                try:
                    char = self.held[:size].decode() if size else ""
                except UnicodeDecodeError:
                    char = ""
                self.held = self.held[size if char else 1 :]
                if char:
                    yield "char", char, None, []
        if end and not self.ended:
            self.ended = True
            yield "eof", None, None, []


EVENTS = "stream_id long, seq_no long, kind string, ch string, seq string, args string"


def parse_batch(chunks: DataFrame) -> DataFrame:
    """Events of whole streams: chunks (stream_id, part_no, data) in order of part_no."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(bytes(d) for d in pdf.sort_values("part_no")["data"])
        rows = [(pdf["stream_id"].iloc[0], k, kind, ch, seq, json.dumps(args)) for k, (kind, ch, seq, args) in enumerate(Parser().push(data, True))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return chunks.groupBy("stream_id").applyInPandas(one, EVENTS)


def parse_stream(chunks: DataFrame) -> DataFrame:
    """Events of growing streams; the bytes of an unfinished sequence are the stream's state."""

    def one(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at = state.get if state.exists else (b"", 0)
        parser, rows = Parser(held=bytes(held)), []
        for part in pd.concat(list(pdfs)).sort_values("part_no").itertuples():
            for kind, ch, seq, args in parser.push(bytes(part.data)):
                rows.append((key[0], at, kind, ch, seq, json.dumps(args)))
                at += 1
        state.update((parser.held, at))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return chunks.groupBy("stream_id").applyInPandasWithState(one, EVENTS, "held binary, at long", "append", GroupStateTimeout.NoTimeout)
