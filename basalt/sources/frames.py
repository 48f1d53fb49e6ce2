"""Validating parser of framed responses, for single files; bulk reads use readers.frame_records."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

HEADER = 21
TERMINATOR = "<![CDATA[]]>\n"
#: Compressed message types, whose length is that of the compressed body; and where each method names its fields.
COMPRESSED = ("96",)
FIELDS_AT = {"query_trade_dates": 9, "query_all_stock": 8, "query_stock_basic": 9, "query_history_k_data_plus": 8, "query_dividend_data": 10, "query_adjust_factor": 10}


class FrameError(ValueError):
    """A frame that does not keep the protocol."""


@dataclass(frozen=True)
class Frame:
    version: str
    message_type: str
    body_length: int
    error_code: str
    error_message: str
    method: str
    page: int
    page_size: int
    fields: tuple[str, ...]
    records: tuple[dict, ...]


def _body(text: str) -> str:
    """Without the transport's end and the checksum."""
    text = text.removesuffix(TERMINATOR) if text.endswith(TERMINATOR) else text.removesuffix("\n")
    head, sep, tail = text.rpartition("\x01")
    return head if sep and re.fullmatch(r"\d+", tail) else text


def parse_frame(data: bytes) -> Frame:
    text = data.decode("utf-8", "replace")
    if len(text) < HEADER:
        raise FrameError("shorter than a header")
    header = text[:HEADER].split("\x01")
    if len(header) != 3:
        raise FrameError("the header has not three parts")
    version, kind, length = header[0], header[1], int(header[2])
    body = _body(text[HEADER:])
    if kind not in COMPRESSED and len(body) != length:
        raise FrameError(f"the body has {len(body)} characters, not {length}")
    parts = body.split("\x01")
    part = lambda i: parts[i] if i < len(parts) else ""
    method = part(2)
    if method not in FIELDS_AT:
        raise FrameError(f"unknown method {method!r}")
    rows = json.loads(part(6))["record"] if part(6).strip() else []
    fields = tuple(x.strip() for x in part(FIELDS_AT[method]).split(",") if x.strip())
    for r in rows:
        if len(r) != len(fields):
            raise FrameError(f"{method}: a row of {len(r)} values for {len(fields)} fields")
    number = lambda t: int(t) if t.strip().isdigit() else 0
    return Frame(version, kind, length, part(0), part(1), method, number(part(4)), number(part(5)), fields, tuple(dict(zip(fields, r, strict=True)) for r in rows))
