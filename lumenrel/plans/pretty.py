"""The PP structure: documents that choose their line breaks when they are laid out (after Wadler, Leijen and Lindig)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


class Doc:
    """A document; documents are built by the functions below."""


@dataclass(frozen=True)
class Text(Doc):
    s: str


@dataclass(frozen=True)
class Break(Doc):
    """flat: what it is on one line (None: it always breaks)."""

    flat: str | None


@dataclass(frozen=True)
class Beside(Doc):
    parts: tuple[Doc, ...]


@dataclass(frozen=True)
class Nest(Doc):
    by: int
    of: Doc


@dataclass(frozen=True)
class Group(Doc):
    of: Doc


@dataclass(frozen=True)
class Align(Doc):
    of: Doc


empty: Doc = Text("")
line, line_break, hard_line = Break(" "), Break(""), Break(None)
soft_line, soft_break = Group(line), Group(line_break)
text = Text
group, align = Group, Align


def beside(a: Doc, b: Doc) -> Doc:
    return Beside((a, b))


def nest(i: int, d: Doc) -> Doc:
    return Nest(i, d)


def hang(i: int, d: Doc) -> Doc:
    return Align(Nest(i, d))


def indent(i: int, d: Doc) -> Doc:
    return hang(i, beside(Text(" " * i), d))


def _joined(ds: Sequence[Doc], by: Doc) -> Doc:
    parts: list[Doc] = []
    for k, d in enumerate(ds):
        parts += [by, d] if k else [d]
    return Beside(tuple(parts))


def hsep(ds): return _joined(ds, Text(" "))
def vsep(ds): return _joined(ds, line)
def sep(ds): return Group(vsep(ds))
def hcat(ds): return _joined(ds, empty)
def vcat(ds): return _joined(ds, line_break)
def cat(ds): return Group(vcat(ds))
def fill_sep(ds): return _joined(ds, soft_line)
def fill_cat(ds): return _joined(ds, soft_break)


def pack(glue: Doc, ds: Sequence[Doc]) -> Doc:
    """As many documents on each line as fit whole, joined by glue; each is an indivisible unit."""
    gap = Break(glue.s) if isinstance(glue, Text) else beside(glue, line_break)
    return Beside(tuple(Group(beside(gap, d)) if k else d for k, d in enumerate(ds)))


def punctuate(by: Doc, ds: Sequence[Doc]) -> list[Doc]:
    return [beside(d, by) if k + 1 < len(ds) else d for k, d in enumerate(ds)]


def enclose_sep(left: Doc, right: Doc, by: Doc, ds: Sequence[Doc]) -> Doc:
    return Beside((left, Align(sep(punctuate(by, ds))), right))


def parens(d): return Beside((Text("("), d, Text(")")))
def brackets(d): return Beside((Text("["), d, Text("]")))
def braces(d): return Beside((Text("{"), d, Text("}")))


def _fits(room: int, todo: list[tuple[int, bool, Doc]]) -> bool:
    """Whether what comes next, up to the first break taken, has room on the line."""
    todo = list(todo)
    while room >= 0:
        if not todo:
            return True
        at, flat, d = todo.pop()
        if isinstance(d, Text):
            room -= len(d.s)
        elif isinstance(d, Break):
            if not flat:
                return True
            if d.flat is None:
                return False
            room -= len(d.flat)
        elif isinstance(d, Beside):
            todo += [(at, flat, x) for x in reversed(d.parts)]
        elif isinstance(d, (Nest, Align)):
            todo.append((at, flat, d.of))
        elif isinstance(d, Group):
            todo.append((at, flat, d.of))  # one that comes later may still break
    return False


def render(width: int, d: Doc) -> str:
    """The most compact layout within the width."""
    out: list[str] = []
    column, todo = 0, [(0, False, d)]
    while todo:
        at, flat, d = todo.pop()
        if isinstance(d, Text):
            out.append(d.s)
            column += len(d.s)
        elif isinstance(d, Break):
            if flat and d.flat is not None:
                out.append(d.flat)
                column += len(d.flat)
            else:
                out.append("\n" + " " * at)
                column = at
        elif isinstance(d, Beside):
            todo += [(at, flat, x) for x in reversed(d.parts)]
        elif isinstance(d, Nest):
            todo.append((at + d.by, flat, d.of))
        elif isinstance(d, Align):
            todo.append((column, flat, d.of))
        elif isinstance(d, Group):
            todo.append((at, flat or _fits(width - column, [*todo, (at, True, d.of)]), d.of))
    return "".join(out)


STRUCTURE = {
    "align": align, "beside": beside, "braces": braces, "brackets": brackets, "cat": cat, "empty": empty, "encloseSep": enclose_sep, "fillCat": fill_cat, "fillSep": fill_sep, "group": group, "hang": hang, "hardLine": hard_line, "hcat": hcat, "hsep": hsep,
    "indent": indent, "line": line, "lineBreak": line_break, "nest": nest, "pack": pack, "parens": parens, "punctuate": punctuate, "render": render, "sep": sep, "softBreak": soft_break, "softLine": soft_line, "text": text, "vcat": vcat, "vsep": vsep,
}
