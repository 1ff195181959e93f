"""The page selector's grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass


class PageSelectionSyntaxError(ValueError):
    """Not a page selector."""


def _bad(selector: str | None) -> PageSelectionSyntaxError:
    return PageSelectionSyntaxError(f"invalid page selector: {selector}")


class PageSelectionUnavailableError(LookupError):
    """A page that the selector needs isn't there."""

    def __init__(self, page: int):
        super().__init__(f"page {page} is not available")
        self.page = page


@dataclass(frozen=True)
class Term:
    """all, page (start), range (start to end) or from (start to the last page)."""

    kind: str
    start: int = 0
    end: int = 0


def parse_selector(selector: str | None) -> list[Term] | None:
    """Terms of ``N``, ``A-B``, ``A-``, ``-B``, their lists, or ``all``; None stands for the default page."""
    if selector is None:
        return None
    parts = [p.strip() for p in selector.strip().split(",")]
    if parts == ["all"]:
        return [Term("all")]
    out = []
    for p in parts:
        m = re.fullmatch(r"([1-9]\d*)|([1-9]\d*)?-([1-9]\d*)?", p, flags=re.ASCII)
        if m is None or p == "-":
            raise _bad(selector)
        if m.group(1):
            out.append(Term("page", int(p)))
        elif not m.group(3):
            out.append(Term("from", int(m.group(2))))
        else:
            t = Term("range", int(m.group(2) or 1), int(m.group(3)))
            if t.start > t.end:
                raise _bad(selector)
            out.append(t)
    return out


def resolve(selector: str | None, available: list[int], default: int = 1) -> list[int]:
    """The pages of one source, in order; every page that the selector spans must be there, but for ``all``."""
    terms, have = parse_selector(selector), sorted(set(available))
    if terms and terms[0].kind == "all":
        if not have:
            raise PageSelectionUnavailableError(default)
        return have
    want: set[int] = set()
    for t in terms or [Term("page", default)]:
        if not have:
            raise PageSelectionUnavailableError(default)
        if t.kind == "from" and t.start > have[-1]:
            raise PageSelectionUnavailableError(t.start)
        end = have[-1] if t.kind == "from" else t.start if t.kind == "page" else t.end
        need = range(t.start, end + 1)
        gap = next((p for p in need if p not in have), None)
        if gap is not None:
            raise PageSelectionUnavailableError(gap)
        want.update(need)
    return sorted(want)
