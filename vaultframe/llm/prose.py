"""The blocks of a Markdown body: where they begin and end, and which of them are prose."""

from __future__ import annotations

import re

import numpy as np

from vaultframe.llm import kernel

_FENCE = re.compile(rb" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_ITEM = re.compile(r"[ \t]*(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)")
_INTERRUPTS = re.compile(r" {0,3}(?:[-+*]|1[.)])[ \t]+\S")
_SENTENCE = re.compile(r"[.!?](?=\s|$)|。")


def flat_lines(body: bytes) -> bytes:
    """The body with every line end as LF, offsets unchanged: CR LF becomes space and LF, a lone CR becomes LF."""
    return body.replace(b"\r\n", b" \n").replace(b"\r", b"\n") if b"\r" in body else body


def scan_blocks(body: bytes, headings: list[tuple[int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, level, fenced) of each block of a body: separated by blank lines, and begun by each heading of `headings`
    (offset, level); a fence is never separated inside. `end` excludes the last line's end; `level` is 0 where no heading begins it."""
    flat = flat_lines(body)
    levels = dict(headings)
    marks = sorted(levels)
    nth, out = 0, []
    start = end = -1
    level, fenced, fence = 0, False, b""
    at = 0
    for line in flat.split(b"\n"):
        stop = at + len(line)
        if at and at == len(body):  # what follows the last line's end is no line
            break
        while nth < len(marks) and marks[nth] < at:
            nth += 1
        if fence:
            bare = line.strip(b" \t")
            if len(bare) >= len(fence) and bare == fence[:1] * len(bare) and len(line) - len(line.lstrip(b" ")) < 4:
                fence = b""
        elif not line.strip(b" \t"):
            if start >= 0:
                out.append((start, end, level, fenced))
                start = -1
            at = stop + 1
            continue
        else:
            begins = nth < len(marks) and marks[nth] <= stop
            if begins or start < 0:
                if start >= 0:
                    out.append((start, end, level, fenced))
                start, level, fenced = (marks[nth], levels[marks[nth]], False) if begins else (at, 0, False)
            opened = _FENCE.match(line)
            if opened:
                fence, fenced = opened.group(1), True
        if start >= 0:
            end = stop - 1 if stop < len(body) and body[stop - 1 : stop + 1] == b"\r\n" else stop
        at = stop + 1
    if start >= 0:
        out.append((start, end, level, fenced))
    return out


def paragraphs(body: str) -> list[str]:
    """The prose of a body: its paragraphs, without headings, lists, block quotes, tables, rules, comments and fenced code. A list
    or quote takes the lines up to the next blank one; after a blank line inside a list, indented lines are still the list's."""
    out: list[str] = []
    now: list[str] = []
    mode, fence = "", ""  # mode: what lines up to the next blank one belong to
    listed = False

    def close() -> None:
        if now:
            out.append("\n".join(now))
            now.clear()

    text = body.replace("\r\n", "\n").replace("\r", "\n") if "\r" in body else body
    for line in text.split("\n"):
        bare = line.strip(" \t")
        if fence:
            if bare[:3] == fence[:3] and len(bare) >= len(fence) and bare == fence[0] * len(bare):
                fence = ""
            continue
        if mode == "comment":
            if "-->" in line:
                mode = ""
            continue
        if not bare:
            close()
            mode = ""
            continue
        head = bare[0]
        if head in "`~" and (bare.startswith("```") or bare.startswith("~~~")) and not (head == "`" and "`" in bare.lstrip("`")):
            close()
            mode, fence = "", bare[: len(bare) - len(bare.lstrip(head))]
            continue
        if mode in ("list", "quote", "table"):
            if head == "#" and _HEADING.match(line):
                mode, listed = "", False
            elif head == ">" and mode == "list":
                mode = "quote"
            elif mode != "list" and _ITEM.match(line):
                mode, listed = "list", True
            continue
        if head == "#" and _HEADING.match(line):
            close()
            listed = False
        elif now and head in "=-" and _UNDERLINE.match(line):
            now.clear()  # the lines above it are a heading
        elif head in "-*_" and _RULE.match(line):
            close()
            listed = False
        elif head == ">":
            close()
            mode, listed = "quote", False
        elif head == "|":
            close()
            mode, listed = "table", False
        elif bare.startswith("<!--"):
            close()
            mode = "" if "-->" in bare else "comment"
        elif (head in "-+*" or head.isdigit()) and (_INTERRUPTS.match(line) if now else _ITEM.match(line)):
            close()
            mode, listed = "list", True
        elif listed and not now and line[:1] in " \t":
            mode = "list"
        else:
            listed = False
            now.append(bare)
    close()
    return out


def measures(bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each body's prose: its words, letters and sentences, and the hashes of its lower-cased words, all texts in a row."""
    prose, sentences = [], np.zeros(len(bodies), np.int64)
    for i, body in enumerate(bodies):
        found = paragraphs(body) if body else []
        n = 0
        for p in found:
            n += len(_SENTENCE.findall(p)) + (p[-1] not in ".!?。")
        sentences[i] = n
        prose.append("\n".join(found))
    _, points, starts = kernel.join_texts(prose)
    begin, stop = kernel.runs((kernel.char_classes()[points] & (kernel.LETTER | kernel.NUMBER)) > 0)
    limits = np.searchsorted(begin, starts)
    letters = np.concatenate(([0], np.cumsum(stop - begin)))
    low, _ = kernel.words([p.lower() for p in prose])
    hashes = low if len(low) == len(begin) else kernel.span_hashes(points, begin, stop)  # lower-casing may split a word
    return np.diff(limits), letters[limits[1:]] - letters[limits[:-1]], sentences, hashes
