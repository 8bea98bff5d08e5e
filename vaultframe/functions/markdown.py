"""One pass over a Markdown body: headings, links of both families, tags and block ids, with byte spans. Code is opaque to all.

A CommonMark subset: block quotes, lists, fences, indented code, ATX and setext headings, rules, HTML comments and blocks; code spans,
escapes, inline links, images, autolinks and inline HTML. Reference links, images and autolinks make no link.
"""

from __future__ import annotations

import bisect

import regex

_QUOTE = regex.compile(r" {0,3}> ?")
_ITEM = regex.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( {1,4}(?=\S)| +|$)")
_RULE = regex.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ATX = regex.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
_SETEXT = regex.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = regex.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
_TICKS = regex.compile(r"\\[\\`]|`+")
_ANGLE = regex.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>]+|/?[A-Za-z][^<>]*|!--.*?-->|\?.*?\?>)>?", regex.S)
_WIKI = regex.compile(r"(!?)\[\[([^\]]+)\]\]")
_INLINE = regex.compile(
    r"""(?<!\\)(!?)\[((?:[^\[\]\\]|\\.|\[(?:[^\[\]\\]|\\.)*\])*)\]\(\s*(<(?:[^<>\n\\]|\\.)*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""", regex.S
)
_DEFINITION = regex.compile(r" {0,3}\[[^\]]+\]:\s*\S")
_TAG = regex.compile(r"(?<![\p{L}\p{M}\p{N}_])#([\p{L}\p{M}\p{N}_/-]+)")
_NOT_DIGIT = regex.compile(r"[^\p{N}]")
_WHOLE_TAG = regex.compile(r"#?([\p{L}\p{M}\p{N}_/-]+)")
_PROTOCOL = regex.compile(r"([a-z][a-z0-9+.-]*)://(.+)", regex.S)
_BLOCK_ID = regex.compile(r"(?:^|\s)\^([A-Za-z0-9_-]+)\s*$")
_ESCAPE = regex.compile(r"\\([!-/:-@\[-`{-~])")
_SLUG_DROP = regex.compile(r"[^\p{Alphabetic}\p{N}\p{M}_\- ]")
_LINE = regex.compile(r"\r\n|\n|\r")


def slugify(text: str) -> str:
    return _SLUG_DROP.sub("", text.strip().lower()).replace(" ", "-")


class Slugs:
    """Slugs in document order; a repeated one gets -1, -2 ..., and a suffixed slug is itself taken."""

    def __init__(self) -> None:
        self.taken: dict[str, int] = {}

    def issue(self, text: str) -> str:
        base = slugify(text)
        if base not in self.taken:
            self.taken[base] = 0
            return base
        while True:
            self.taken[base] += 1
            slug = f"{base}-{self.taken[base]}"
            if slug not in self.taken:
                self.taken[slug] = 0
                return slug


class Spans:
    """Character offsets to (line, column, offset) in bytes; breaks are LF, CR LF and lone CR."""

    def __init__(self, text: str) -> None:
        self.text, self.plain = text, text.isascii()
        self.lines = [0, *(m.end() for m in _LINE.finditer(text))]
        self.bytes = None if self.plain else [0]
        if not self.plain:
            for a, b in zip(self.lines, [*self.lines[1:], len(text)]):
                self.bytes.append(self.bytes[-1] + len(text[a:b].encode("utf-8", "surrogatepass")))

    def at(self, i: int) -> tuple[int, int, int]:
        n = bisect.bisect_right(self.lines, i) - 1
        if self.plain:
            return n + 1, i - self.lines[n] + 1, i
        column = len(self.text[self.lines[n] : i].encode("utf-8", "surrogatepass"))
        return n + 1, column + 1, self.bytes[n] + column


def split_fragment(target: str) -> tuple[str, str | None, str | None]:
    """(target, anchor, block reference) at the first '#'; a bare '^' is an ordinary character."""
    head, mark, rest = target.partition("#")
    if not mark:
        return target, None, None
    return (head, None, rest[1:]) if rest.startswith("^") else (head, rest, None)


def wikilink(embed: str, inner: str) -> dict:
    target, bar, title = inner.partition("|")
    found = _PROTOCOL.fullmatch(target.strip())
    name, anchor, block = split_fragment(found.group(2) if found else target.strip())
    return {"family": "wikilink", "embed": embed == "!", "protocol": found.group(1) if found else None, "target": name.strip(), "title": title if bar else None, "anchor": anchor, "block_ref": block}


def inline_link(text: str, destination: str) -> dict:
    raw = destination[1:-1] if destination.startswith("<") else destination
    found = _PROTOCOL.fullmatch(raw)
    raw = found.group(2) if found else raw
    cut = regex.search(r"(?<!\\)#", raw)
    head, rest = (raw[: cut.start()], raw[cut.end() :]) if cut else (raw, None)
    anchor, block = (None, rest[1:]) if rest is not None and rest.startswith("^") else (rest, None)
    plain = lambda s: None if s is None else _ESCAPE.sub(r"\1", s)
    return {"family": "markdown", "embed": False, "protocol": found.group(1) if found else None, "target": plain(head), "title": flatten(text), "anchor": plain(anchor), "block_ref": plain(block)}


def flatten(text: str) -> str:
    """A heading's or a link's text without its marks."""
    out, at = [], 0
    for a, b, n in code_spans(text):
        out.append(_unmark(text[at:a]))
        code = text[a + n : b - n].replace("\n", " ")
        out.append(code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code)
        at = b
    out.append(_unmark(text[at:]))
    return "".join(out)


def _unmark(s: str) -> str:
    if not any(c in s for c in "*_[]<\\&"):
        return s
    s = _INLINE.sub(lambda m: flatten(m.group(2)), s)
    s = regex.sub(r"(?<!\\)(\*{1,3})(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    s = regex.sub(r"(?<![\p{L}\p{N}\\_])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?![\p{L}\p{N}_])", r"\2", s)
    return _ESCAPE.sub(r"\1", s)


def code_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, ticks) of the code spans of one paragraph: a run of backticks up to the next run as long."""
    if "`" not in text:
        return []
    runs = [(m.start(), m.end()) for m in _TICKS.finditer(text) if m.group()[0] == "`"]
    out, k = [], 0
    while k < len(runs):
        a, b = runs[k]
        close = next((j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] == b - a), None)
        if close is None:
            k += 1
            continue
        out.append((a, runs[close][1], b - a))
        k = close + 1
    return out


class Body:
    """The facts of one body: `headings`, `links`, `tags`, `blocks`, in order."""

    def __init__(self, body: str) -> None:
        self.body, self.spans = body, Spans(body)
        self.opaque: list[tuple[int, int]] = []  # code
        self.constructs: list[tuple[int, int]] = []  # links, images, HTML, definitions: no tags inside
        self.links: list[dict] = []
        self.headings: list[dict] = []
        self._slugs = Slugs()
        self._blocks()
        self.opaque.sort()
        self.links.sort(key=lambda x: (x["at"], x["family"] != "wikilink"))
        self.tags = self._tags()
        self.blocks = self._block_ids()

    # blocks

    def _blocks(self) -> None:
        body = self.body
        starts = self.spans.lines
        para: list[tuple[int, int]] = []
        boxed = False  # the open paragraph stands in a quote or a list
        fence: tuple[str, int, int] | None = None
        html = ""
        indent = 0  # content column of the open list item, 0 outside lists
        blank = True
        for n, start in enumerate(starts):
            stop = starts[n + 1] if n + 1 < len(starts) else len(body)
            end = stop
            while end > start and body[end - 1] in "\r\n":
                end -= 1
            if start == len(body) and n:
                break
            at, depth = start, 0
            while True:
                m = _QUOTE.match(body, at, end)
                if not m or (fence and depth >= fence[2]):
                    break
                at, depth = m.end(), depth + 1
            if fence and depth < fence[2]:
                fence = None
            line = body[at:end]
            if fence:
                self.opaque.append((start, stop))
                bare = line.strip(" \t")
                if len(bare) >= fence[1] and bare == fence[0] * len(bare):
                    fence = None
                continue
            if html:
                self.constructs.append((start, stop))
                if html in line:
                    html = ""
                continue
            if not line.strip(" \t"):
                self._close(para)
                para, blank = [], True
                continue
            lead = len(line) - len(line.lstrip(" "))
            if line[:1] == "\t":
                lead = 4
            inner = depth > 0
            if indent and lead >= indent:
                at, lead, inner = at + indent, lead - indent, True
                line = body[at:end]
            elif indent and not para:
                indent = 0
            elif indent and blank:
                indent = 0
            if para and _SETEXT.match(line) and not (boxed and not inner):
                level = 1 if "=" in line else 2
                self._heading(para, level, para[0][0], stop, boxed)
                para, blank = [], False
                continue
            if lead >= 4 and not para:
                self.opaque.append((start, stop))
                blank = False
                continue
            while not _RULE.match(line):
                m = _ITEM.match(line)
                if not m or (para and (m.group(2)[0].isdigit() and m.group(2)[:-1] != "1" or m.end() == len(line))):
                    break
                self._close(para)
                para, inner = [], True
                width = m.end() if m.group(3) else m.end() + 1
                indent = (indent if lead and indent else 0) + width if not indent or lead else width
                at += m.end()
                line = body[at:end]
                lead = 0
                if not line:
                    break
            if not line.strip():
                blank = False
                continue
            if _RULE.match(line):
                self._close(para)
                para, blank = [], False
                continue
            m = _ATX.match(line)
            if m:
                self._close(para)
                para, blank = [], False
                hash_at = at + line.index("#")
                text_at = at + m.end()
                text = body[text_at:end].rstrip(" \t")
                closing = regex.search(r"(?:^|[ \t]+)#+$", text)
                if closing:
                    text = text[: closing.start()]
                self._heading([(text_at, text_at + len(text))], len(m.group(1)), hash_at, stop, inner)
                continue
            m = _FENCE.match(line)
            if m:
                self._close(para)
                para, blank = [], False
                fence = (m.group(2)[0], len(m.group(2)), depth)
                self.opaque.append((start, stop))
                continue
            if not para and _DEFINITION.match(line) and not line.lstrip().startswith("[^"):
                self.constructs.append((start, stop))
                blank = False
                continue
            if line.lstrip(" ").startswith("<!--"):
                self._close(para)
                para = []
                self.constructs.append((start, stop))
                if "-->" not in line:
                    html = "-->"
                blank = False
                continue
            if not para:
                boxed = inner
            begin = at + len(line) - len(line.lstrip(" \t"))
            para.append((begin, end))
            blank = False
        self._close(para)

    def _close(self, para: list[tuple[int, int]]) -> None:
        if para:
            self._inline(para)

    def _heading(self, lines: list[tuple[int, int]], level: int, start: int, stop: int, boxed: bool) -> None:
        text = "\n".join(self.body[a:b].rstrip(" \t") for a, b in lines)
        flat = flatten(text).replace("\n", " ").strip()
        line, column, offset = self.spans.at(start)
        self.headings.append({"ordinal": len(self.headings), "text": flat, "slug": self._slugs.issue(flat), "level": level, "span_line": line, "span_column": column, "span_offset": offset, "body_offset": self.spans.at(stop)[2], "inside_container": boxed})
        self._inline(lines)

    # inlines

    def _inline(self, lines: list[tuple[int, int]]) -> None:
        """Code spans, links and constructs of the text of one paragraph, whose lines may stand behind quote marks."""
        text = "\n".join(self.body[a:b] for a, b in lines)
        if not any(c in text for c in "`[<"):
            return
        begins, at = [], 0
        for a, b in lines:
            begins.append(at)
            at += b - a + 1

        def place(i: int) -> int:
            k = bisect.bisect_right(begins, i) - 1
            return lines[k][0] + min(i - begins[k], lines[k][1] - lines[k][0])

        codes = code_spans(text)
        masked = text
        for a, b, _ in codes:
            self.opaque.append((place(a), place(b - 1) + 1))
            masked = masked[:a] + "\x00" * (b - a) + masked[b:]
        if "[[" in masked:
            for m in _WIKI.finditer(masked):
                found = wikilink(m.group(1), text[m.start(2) : m.end(2)])
                if "\x00" in m.group() or not (found["target"] or found["anchor"] is not None or found["block_ref"] is not None):
                    continue
                self._link(found, place(m.start()))
                self.constructs.append((place(m.start()), place(m.end() - 1) + 1))
        if "](" in masked:
            self._inlines(masked, text, 0, place)
        if "<" in masked:
            for m in _ANGLE.finditer(masked):
                self.constructs.append((place(m.start()), place(m.end() - 1) + 1))

    def _inlines(self, masked: str, text: str, base: int, place) -> None:
        for m in _INLINE.finditer(masked):
            a, b = place(base + m.start()), place(base + m.end() - 1) + 1
            self.constructs.append((a, b))
            if m.group(1):
                self._inlines(m.group(2), text[m.start(2) : m.end(2)], base + m.start(2), place)
                continue
            self._link(inline_link(text[m.start(2) : m.end(2)], text[m.start(3) : m.end(3)]), a)

    def _link(self, link: dict, at: int) -> None:
        line, column, offset = self.spans.at(at)
        self.links.append({**link, "at": at, "span_line": line, "span_column": column, "span_offset": offset})

    # scans over the whole body

    def _tags(self) -> list[dict]:
        out = []
        if "#" not in self.body:
            return out
        closed = merge(self.opaque + self.constructs)
        begins = [a for a, _ in closed]
        for m in _TAG.finditer(self.body):
            k = bisect.bisect_right(begins, m.start()) - 1
            if (k >= 0 and m.start() < closed[k][1]) or not _NOT_DIGIT.search(m.group(1)):
                continue
            line, column, offset = self.spans.at(m.start())
            out.append({"name": m.group(1), "source": "body", "span_line": line, "span_column": column, "span_offset": offset})
        return out

    def _block_ids(self) -> list[dict]:
        out = []
        if "^" not in self.body:
            return out
        closed = merge(self.opaque)
        begins = [a for a, _ in closed]
        lines = self.spans.lines
        for n, start in enumerate(lines):
            stop = lines[n + 1] if n + 1 < len(lines) else len(self.body)
            m = _BLOCK_ID.search(self.body[start:stop].rstrip("\r\n"))
            if m:
                at = start + m.start(1) - 1
                k = bisect.bisect_right(begins, at) - 1
                if k >= 0 and at < closed[k][1]:
                    continue
                line, column, offset = self.spans.at(at)
                out.append({"ordinal": len(out), "block_id": m.group(1), "span_line": line, "span_column": column, "span_offset": offset})
        return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_tag(text: str) -> str | None:
    """A frontmatter string that is a tag, the marker optional; the whole string must be one."""
    m = _WHOLE_TAG.fullmatch(text)
    return m.group(1) if m and _NOT_DIGIT.search(m.group(1)) else None


def wikilinks_in(text: str) -> list[tuple[int, dict]]:
    return [(m.start(), wikilink(m.group(1), m.group(2))) for m in _WIKI.finditer(text)]
