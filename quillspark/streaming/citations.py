"""Citations resolved on a stream of text pieces: a marker may be cut between two pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions import citations

MARKER = re.compile(citations.MARKER)
OPENING = "[ref:"


def numbers(inside: str) -> list[int]:
    """1,3-5 to 1, 3, 4, 5."""
    found = []
    for part in inside.replace(" ", "").split(","):
        if re.fullmatch(r"\d+-\d+", part):
            first, last = sorted(map(int, part.split("-")))
            found += range(first, last + 1)
        elif part.isdigit():
            found.append(int(part))
    return found


def resolved(text: str, links: dict[int, str]) -> str:
    def link(found: re.Match) -> str:
        return " ".join(dict.fromkeys(links[n] for n in numbers(found[1]) if n in links))

    return MARKER.sub(link, text)


def take(buffer: str, piece: str) -> tuple[str, str]:
    """What can be emitted of buffer and piece, and what has to wait for the rest of a marker."""
    text = buffer + piece
    at = text.rfind("[")
    waits = at >= 0 and may_become_marker(text[at:].lower())
    return (text[:at], text[at:]) if waits else (text, "")


def may_become_marker(begun: str) -> bool:
    """Whether the rest of a marker can still follow: the text is shorter than the opening and agrees with it, or has only what stands inside a marker after it."""
    return begun == OPENING[: len(begun)] or (begun.startswith(OPENING) and all(c.isdigit() or c.isspace() or c in ",-" for c in begun[len(OPENING) :]))


def resolved_stream(pieces: DataFrame, links: dict[int, str], timeout: str = "NoTimeout", idle_ms: int = 60_000) -> DataFrame:
    """pieces (run_uuid, at, text), a stream, to (run_uuid, text): the text with its markers resolved, as far as it is complete.

    The state of a run is what waits; it is emitted when a piece is marked last (an empty text) or, with ProcessingTimeTimeout, when the run is idle (a query
    with that timeout runs until it is stopped, with the availableNow trigger too). Links are those of one answer, so few.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = state.get[0] if state.exists else ""
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_uuid": [key[0]], "text": [resolved(buffer, links)]})
            return
        out, ended = "", False
        for piece in pd.concat(list(batches)).sort_values("at").text:
            emitted, buffer = take(buffer, piece)
            out += emitted
            if piece == "":
                out, buffer, ended = out + buffer, "", True
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((buffer,))
            if timeout != "NoTimeout":
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"run_uuid": [key[0]], "text": [resolved(out, links)]})

    grouped = pieces.groupBy("run_uuid")
    return grouped.applyInPandasWithState(update, "run_uuid long, text string", "buffer string", "append", getattr(GroupStateTimeout, timeout))
