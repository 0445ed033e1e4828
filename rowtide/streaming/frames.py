"""Events pushed by a server: frames that come one by one through an injected transport."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from ..sources import wire
from ..sources.events import Bounds, Decoder, Event


class FrameError(wire.LogError):
    code = "bad_frame"


def decode_frames(frames: Iterable[tuple[bytes, str | None]], name: str, bounds: Bounds | None = None, pos: int = 4) -> Iterator[Event]:
    """Events of (frame, rotate hint) pairs, in the same form as from files.

    A frame must be as long as its header says. Heartbeats are swallowed. Frames without a place of their own
    (log_pos 0: the rotate and format description that open a stream) name the file but never move the position.
    """
    decoder = Decoder(name, 0, bounds or Bounds())
    chain = pos
    for frame, hint in frames:
        h = wire.parse_header(frame[: wire.HEADER_SIZE])
        if len(frame) != h.size:
            raise FrameError(f"a frame of {len(frame)} bytes says {h.size}")
        if h.type == wire.HEARTBEAT:
            continue
        if h.log_pos == 0 and h.type == wire.ROTATE:
            body = frame[wire.HEADER_SIZE :]
            chain = int.from_bytes(body[:8], "little")
            decoder.name = hint or body[8:].rstrip(b"\0").decode("utf-8", "replace")
            continue
        event = decoder.feed(chain, h, lambda frame=frame: frame)
        if decoder.done:
            return
        if h.log_pos:
            chain = h.log_pos
        if event:
            yield event
