"""Plain Python twins of ``text``, for work inside a document, and the inline renderer."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from hashlib import sha256
from html import unescape
from html.parser import HTMLParser
from typing import Any

from folioscan.functions.text import LOWER_UNITS, MISSING

ORDINALS = frozenset("rank row position order index".split())
_TAIL_UNIT = re.compile(r"(?:\[(?P<square>[^\]\[]*)\]|\((?P<round>[^)(]*)\))\s*$")
_DIGITS = r"\s*([+-]?\d[,\d]*(?:\.\d+)?(?:[Ee][+-]?\d+)?)"
_NUMBER = re.compile(_DIGITS)
_QUANTITY = re.compile(_DIGITS + r"\s*([%$€£¥°Ωµμa-zA-Z][%$€£¥°Ωµμ·*^./0-9a-zA-Z_-]*)\s*$")
_CAPTION_ID = re.compile(r"(?a)\s*\{#(?P<id>[a-zA-Z][\w.:-]*)\}\s*$")


def collapse_space(s: str) -> str:
    return " ".join(s.split())


def slug(s: str, fallback="table") -> str:
    return "-".join(re.findall("[a-z0-9]+", s.lower())) or fallback


def caption_and_id(s: str) -> tuple[str, str | None]:
    m = _CAPTION_ID.search(s)
    return (s[: m.start()].strip(), m.group(1)) if m else (s.strip(), None)


def is_missing(s: str) -> bool:
    return s.strip().lower() in MISSING


def looks_like_unit(s: str) -> bool:
    u = collapse_space(s)
    if not 0 < len(u) <= 32:
        return False
    if set(u) & set("°%/$€£¥·^"):
        return True
    return " " not in u and (u.casefold() in LOWER_UNITS or any(c.isupper() or c.isdigit() for c in u))


@lru_cache(4096)  # headers, asked for with every row
def header_unit(s: str) -> str | None:
    m = _TAIL_UNIT.search(s)
    unit = collapse_space(m["round"] or m["square"] or "") if m else ""
    return unit if looks_like_unit(unit) else None


def cell_unit(s: str) -> str | None:
    m = _QUANTITY.match(s)
    return m.group(2) if m else None


@lru_cache(4096)
def normalise_label(s: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", (_TAIL_UNIT.sub("", s) if header_unit(s) else s).lower()))


def number(s: str) -> float | None:
    m = _NUMBER.match(s)
    return float(m.group(1).replace(",", "")) if m else None


def sentence(s: str) -> str:
    s = collapse_space(s)
    return s if not s or s[-1] in ".!?" else s + "."


def escape_pipe_cell(s: str) -> str:
    return re.sub(r"([|\\])", r"\\\1", s).replace("\n", "<br>")


def escape_inline(s: str) -> str:
    return re.sub(r"([\\|$*_~`\[\]<>])", r"\\\1", s)


def canonical_json(value: Any) -> str:
    """What hashes are taken of."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def digest(value: Any, digits: int = 64) -> str:
    return sha256(canonical_json(value).encode("utf-8", "surrogatepass")).hexdigest()[:digits]


def fence(text: str, language="") -> list:
    """A code block whose fence is longer than any run of its sign inside; tildes where they need fewer."""
    ticks, tildes = (max(map(len, re.findall(f"{c}+", text)), default=0) for c in "`~")
    mark = "`" * max(3, ticks + 1) if ticks <= tildes else "~" * max(3, tildes + 1)
    return [mark + language, text, mark]


class _Strip(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data: str) -> None:
        self.out.append(data)


def strip_html(s: str) -> str:
    p = _Strip()
    p.feed(s)
    p.close()
    return collapse_space(" ".join(x.strip() for x in p.out if x.strip()))


_INLINE = re.compile(
    r"\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|\$(?P<math>[^\s$](?:[^$]*[^\s$])?)\$(?!\d)"
    r"|(?P<image>!?)\[(?P<label>[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]\((?P<target>[^()\s]*)(?:\s+\"[^\"]*\")?\)|<(?P<auto>https?://[^<>\s]+)>|(?P<tag></?[A-Za-z][^<>]*>)"
    r"|(?P<mark>\*\*|__|~~|(?<!\w)_(?=\S)|(?<=\S)_(?!\w)|\*)",
    re.S,
)


def inline_text(s: str) -> str:
    """Markdown of a cell or caption as plain text: code keeps its ticks, math its dollars, links become "label (target)"; emphasis and tags go."""

    def one(m: re.Match) -> str:
        if m["escaped"]:
            return m["escaped"]
        if m["code"] is not None:
            return f"`{m['code'].strip()}`"
        if m["math"]:
            return f"${m['math']}$"
        if m["label"] is not None:
            label = inline_text(m["label"]) or ("image" if m["image"] else "")
            return f"{label} ({m['target']})" if m["target"] else label
        if m["auto"]:
            return f"{m['auto']} ({m['auto']})"
        if m["tag"]:
            return " " if m["tag"].lower().startswith("<br") else ""
        opened = s.count(m["mark"]) > 1  # a lone mark is a sign like any other
        return "" if opened else m["mark"]

    return collapse_space(unescape(_INLINE.sub(one, s)))
