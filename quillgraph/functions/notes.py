"""Stateful reading of Markdown notes: links, citation links, reference lists.

These need a scanner (balanced parentheses, fences, look-ahead), so they are Python
over one note at a time; operators/notes.py runs them over Arrow batches.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from urllib.parse import unquote

import regex as re

from quillgraph.functions.text import SECTION_TITLE

#: The scheme of citation links and its parameters.
CITE_PREFIX = "obsidian://cite?"
PARAMETERS = ("note", "q", "qe", "occ", "doi")
#: How far a heading is looked past, how many entries must follow it, the
#: least run without a heading, the gap and length up to which lines are joined.
LOOKAHEAD, ENTRIES_AFTER, LEAST_RUN, JOIN_GAP, JOIN_LENGTH = 4, 2, 5, 2, 1500
LEAST_ENTRY, YEAR_HEAD = 20, 200

#: The patterns that say what a reference line, a year, a DOI, initials and
#: list markers are; results depend on them to the letter.
_HEADING = re.compile(r"(#{1,6})\s+(.*)$")
_TITLE = re.compile(SECTION_TITLE.replace("(?iu)", ""), re.I)
_BOLD = re.compile(r"\*\*([^*]+)\*\*\s*:?\s*$")
_FENCE = re.compile(r"\s*(```|~~~)")
_MARKER = re.compile(r"(?:[-*+]\s+|[0-9]{1,4}[.)]\s+|\[[0-9]{1,4}\]\s*|\*\*[0-9]{1,4}\*\*\s+|[0-9]{1,3}\s+(?=\p{Lu}))")
_ANCHOR = re.compile(r"(?:<(?:span|a)\b[^<>]*>\s*</(?:span|a)>\s*)+", re.I)
_EDITOR = re.compile(r"\((?:eds?|dir|hrsg)\.?\)", re.I)
_DOI = re.compile(r"\b10\.[0-9]{4,9}/(?:[^\s\"'<>\[\],;()]+|\([^\s()<>]*\))+", re.I)
_YEAR_PAREN = re.compile(r"\((1[5-9][0-9]{2}|20[0-9]{2})[a-z]?[),]")
_YEAR = re.compile(r"\b(1[5-9][0-9]{2}|20[0-9]{2})[a-z]?\b")
_INITIALS = re.compile(r"(?:\p{Lu}{1,3}\.?|(?:\p{Lu}\.[\s-]*)+\p{Lu}?\.?)")
_NAME = re.compile(r"\p{L}[\p{L}\p{N}]*[\p{L}'’. -]{0,40}")
_START = re.compile(r"(?:\*\*)?\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)?(?:,\s*\p{Lu}|\s\p{Lu}{1,3}[,.\s])")
_BEFORE = re.compile(r",|\s\(|\s(?:1[5-9]|20)[0-9]{2}\b")
_SPLIT = re.compile(r"\s*(?:,|;|&|\band\b|\bet\b)\s*")
_ET_AL = re.compile(r"\bet al\b", re.I)
_HIDDEN = re.compile(r"%(2[89]|3[bcde]|5[bd]|2f)", re.I)


@dataclass
class Link:
    start: int
    end: int
    text: str
    url: str


@dataclass
class Entry:
    line: int
    text: str
    first_author: str | None = None
    year: str | None = None
    doi: str | None = None
    authors: list[str] = field(default_factory=list)
    et_al: bool = False


def name_key(name: str) -> str:
    """Letters only, lower case, no accents, as functions.text.name_key has it."""
    whole = "".join(c if "\uac00" <= c <= "\ud7a3" else unicodedata.normalize("NFKD", c) for c in name)
    return "".join(c for c in "".join(c for c in whole if unicodedata.category(c)[0] != "M").lower() if c.isalpha())


def markdown_links(line: str) -> list[Link]:
    """Inline links of a line, left to right. A destination in angle brackets ends at
    the closing one; a bare one at white space (not in citation URLs) or where the
    parentheses close more than was opened."""
    found, at = [], 0
    while (mid := line.find("](", at)) >= 0:
        start, dest = line.rfind("[", 0, mid), mid + 2
        if line[dest : dest + 1] == "<":
            stop = line.find(">", dest + 1)
            if stop < 0:
                break
            url, end = line[dest + 1 : stop], stop + 2
        else:
            spaces = line.startswith(CITE_PREFIX, dest)
            depth, stop = 0, dest
            while stop < len(line):
                c = line[stop]
                depth += (c == "(") - (c == ")")
                if depth < 0 or (c.isspace() and not spaces):
                    break
                stop += 1
            url, end = line[dest:stop], stop + 1
        if start >= at:
            found.append(Link(start, end, line[start + 1 : mid], url))
        at = max(end, dest)
    return found


def percent_decode(text: str) -> str:
    """Escapes decoded; a stray % stays, + is a plus; what isn't UTF-8 stays as it is."""
    try:
        return unquote(re.sub(r"%(?![0-9A-Fa-f]{2})", "%25", text), errors="strict")
    except UnicodeDecodeError:
        return text


def _target(values: dict[str, str]) -> dict:
    own = {k: v.strip() for k, v in values.items() if v is not None and v.strip()}
    occ = re.match(r"[0-9]+", own.pop("occ", ""))
    out = {k: own[k] for k in ("note", "q", "qe", "doi") if k in own}
    if occ and int(occ[0]) > 0:
        out["occ"] = int(occ[0])
    return out


def parse_citation_url(url: str) -> dict | None:
    """note, q, qe, occ, doi of a citation URL. A value runs to the next & that starts
    a known parameter; of repeated ones the first counts."""
    if not url.startswith(CITE_PREFIX):
        return None
    query = url[len(CITE_PREFIX) :]
    marks = list(re.finditer(rf"(?:^|&)({'|'.join(PARAMETERS)})=", query))
    values: dict[str, str] = {}
    for m, after in zip(marks, [*marks[1:], None]):
        values.setdefault(m[1], percent_decode(query[m.end() : after.start() if after else len(query)]))
    return _target(values)


def citation_params(params: dict[str, str]) -> dict:
    """The same of split parameters: unknown ones after q belong to the passage."""
    keys = list(params)
    q = params.get("q")
    for k in keys[keys.index("q") + 1 :] if q is not None else ():
        if k != "action" and k not in PARAMETERS:
            q += f"&{k}" if params[k] in ("true", "") else f"&{k}={params[k]}"
    return _target({k: q if k == "q" else params[k] for k in keys if k in PARAMETERS})


def open_lines(note: str):
    """(number, offset, line) of lines outside of code. A fence turns the state before
    its own line is looked at, so an opening fence is inside and a closing one is not."""
    offset, code = 0, False
    for i, line in enumerate(note.split("\n")):
        code ^= bool(_FENCE.match(line))
        if not code:
            yield i, offset, line
        offset += len(line) + 1


def citation_links(note: str) -> list[dict]:
    out = []
    for i, offset, line in open_lines(note):
        if CITE_PREFIX in line:
            for x in markdown_links(line):
                if (target := parse_citation_url(x.url)) is not None:
                    out.append({"line": i, "start": offset + x.start, "end": offset + x.end, "text": x.text, "url": x.url, **{k: target.get(k) for k in PARAMETERS}})
    return out


def plain_heading(text: str) -> str:
    out = re.sub(r"<(/?)([^<>]*)>", lambda m: m[2] if m[2] and m[2].isalpha() and m[2].isupper() else "", text)
    out = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", out)
    out = re.sub(r"[*_`]", "", out)
    return re.sub(r"\{#[^}]*\}\s*$", "", out).strip()


def is_reference_heading(text: str) -> bool:
    return bool(_TITLE.match(plain_heading(text)))


def family_of(author: str) -> str:
    """The name between initials; a group of three capitals and more is a name."""
    parts = re.sub(r"[()]", " ", author).split()
    first, last = 0, len(parts)
    while first < last and _INITIALS.fullmatch(parts[first]):
        first += 1
    while last > first and _INITIALS.fullmatch(parts[last - 1]):
        last -= 1
    whole = " ".join(parts)
    return " ".join(parts[first:last]) or (whole if len(whole) >= 3 and whole.isalpha() and whole.isupper() else "")


def unescape_doi(text: str) -> str:
    out = re.sub(r"\\([()\[\]_<>;])", r"\1", text)
    return _HIDDEN.sub(lambda m: chr(int(m[1], 16)), out)


def _unmarked(text: str) -> str:
    return _MARKER.sub("", text, count=1).strip() if _MARKER.match(text) else text


def parse_entry(raw: str, line: int = 0) -> Entry | None:
    """A line as a reference; null when it has neither a year near its start nor a DOI."""
    text = _unmarked(_unmarked(raw.strip()))
    if m := _ANCHOR.match(text):
        text = text[m.end() :].strip()
    text = _unmarked(_unmarked(text))
    if len(text) < LEAST_ENTRY or text.startswith(("![", "|", "<")):
        return None
    head = text[:YEAR_HEAD]
    year = _YEAR_PAREN.search(head) or _YEAR.search(head)
    doi = _DOI.search(unescape_doi(text))
    if not year and not doi:
        return None
    entry = Entry(line, text, year=year[1] if year else None, doi=doi[0].rstrip(".").lower() if doi else None)
    plain = re.sub(r"[*_]", "", text)
    cut = _BEFORE.search(plain)
    name = family_of(plain[: cut.start()]) if cut and cut.start() > 0 else ""
    if name and _NAME.fullmatch(name) and len(name) <= 41 and not re.search("[0-9]", name):
        entry.first_author = name
    before = plain[: max(0, plain.find(entry.year))] if entry.year else ""
    before = _EDITOR.sub(" ", before)
    entry.et_al = bool(_ET_AL.search(before))
    if entry.first_author:
        people = re.split(r"\bet al\b", before, maxsplit=1, flags=re.I)[0]
        names = (family_of(p) for p in _SPLIT.split(people))
        entry.authors = [k for p in names if re.search(r"\p{L}{2}", p) and (k := name_key(p))]
    return entry


def _sure_reference(line: str) -> bool:
    entry = parse_entry(line)
    return bool(entry and entry.first_author and (_START.match(_unmarked(line.strip())) or len(entry.first_author.split()) <= 2))


def _entries_follow(lines: list[str], at: int) -> bool:
    ahead = [x for x in map(str.strip, lines[at + 1 :]) if x and not _HEADING.match(x)][:LOOKAHEAD] if at + 1 < len(lines) else []
    return sum(map(_sure_reference, ahead)) >= ENTRIES_AFTER


def section_entries(note: str) -> list[Entry]:
    """Entries below reference headings. A heading of the same or a higher level ends a
    section, unless references follow it; a bold title's section ends at any heading. A
    line close behind an entry that is none itself goes on with it."""
    lines, found, level, last = note.split("\n"), [], None, None
    for i, _, raw in open_lines(note):
        line = raw.rstrip()
        if h := _HEADING.match(line):
            if is_reference_heading(h[2]):
                level = len(h[1])
            elif level is not None and len(h[1]) <= level and not _entries_follow(lines, i):
                level = None
            continue
        bold = _BOLD.match(line.strip())
        if bold and is_reference_heading(bold[1]):
            level = 7
            continue
        if level is None:
            continue
        if entry := parse_entry(line, i):
            found.append(entry)
            last = i
            continue
        rest = _unmarked(line.strip())
        if not found or last is None or i - last > JOIN_GAP or not rest or rest[0] in "![|<":
            continue
        joined = f"{found[-1].text} {rest}"
        if len(joined) <= JOIN_LENGTH and (merged := parse_entry(joined, found[-1].line)):
            found[-1], last = merged, i
    return found


def unheaded_entries(note: str) -> list[Entry]:
    """Runs of reference lines, blank lines and one other line at a time between them."""
    runs: list[list[Entry]] = [[]]
    others = 0
    for i, _, raw in open_lines(note):
        if not (line := raw.strip()):
            continue
        entry = parse_entry(line, i) if _START.match(_unmarked(line)) else None
        if entry and entry.first_author:
            runs[-1].append(entry)
            others = 0
        else:
            others += 1
            if others > 1:
                runs.append([])
                others = 0
    return [e for run in runs if len(run) >= LEAST_RUN for e in run]


def bibliography(note: str) -> list[Entry]:
    return section_entries(note) or unheaded_entries(note)


def without_lines(text: str, entry_lines: list[int]) -> str:
    """The text without its entries, short gaps between them, and up to two lines that
    go on after the last of a run."""
    lines, drop, own = text.split("\n"), set(), sorted(set(entry_lines))
    for at, after in zip(own, [*own[1:], None]):
        if after is not None and after - at <= 4:
            drop.update(range(at, after))
            continue
        drop.add(at)
        for i in range(at + 1, min(at + 3, len(lines))):
            rest = lines[i].strip()
            if not rest or rest.startswith("#"):
                break
            drop.add(i)
    return "\n".join(x for i, x in enumerate(lines) if i not in drop)


_ITEM = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]*)\s*(?:,|$)""")


def scalar(text: str) -> str:
    """A YAML scalar as text: in double quotes a backslash takes the next character as it
    is, in single ones a doubled quote is one."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return text


def frontmatter(text: str) -> tuple[dict[str, object], str]:
    """(properties, body): a line-based subset of YAML: scalars and lists."""
    if not text.startswith("---\n") or (end := text.find("\n---", 3)) < 0:
        return {}, text
    out: dict[str, object] = {}
    key = None
    for line in text[4:end].split("\n"):
        if m := re.match(r"\s*-\s+(.*)$", line):
            if key is not None:
                out[key] = [*(out[key] if isinstance(out[key], list) else []), scalar(m[1])]
        elif m := re.match(r"([^\s:][^:]*):\s*(.*)$", line):
            key, value = m[1].strip(), m[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [scalar(m[1]) for m in _ITEM.finditer(value[1:-1]) if m[1].strip()]
            else:
                out[key] = scalar(value) or None
    return out, text[end + 4 :].lstrip("\n")


def fill_template(template: str, values: dict[str, object]) -> str:
    """{{field}} replaced; in the frontmatter strings are quoted where YAML needs it,
    lists become items, and an empty value leaves the key alone."""
    head, body = "", template
    if template.startswith("---\n") and (end := template.find("\n---", 3)) >= 0:
        head, body = template[: end + 4], template[end + 4 :]

    def plain(m: re.Match) -> str:
        v = values.get(m[1].strip())
        return "" if v is None else ", ".join(v) if isinstance(v, list) else str(v)

    def quoted(s: str) -> str:
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' if re.search(r"[:#\[\]{}\"',&*?|>%@`!]|^[\s-]|\s$", s) else s

    out = []
    for line in head.split("\n"):
        m = re.match(r"([^:\s][^:]*:)\s*\{\{([^}]*)\}\}\s*$", line)
        if m:
            v = values.get(m[2].strip())
            if isinstance(v, list):
                out += [m[1], *(f"  - {quoted(str(x))}" for x in v)]
            else:
                out.append(m[1] if v in (None, "") else f"{m[1]} {quoted(str(v))}")
        else:
            out.append(re.sub(r"\{\{([^}]*)\}\}", plain, line))
    return "\n".join(out) + re.sub(r"\{\{([^}]*)\}\}", plain, body)


def fingerprint(text: str) -> str:
    """FNV-1a, 32 bits, over UTF-16 code units, as 8 hex digits."""
    h = 0x811C9DC5
    data = text.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] | data[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


__all__ = ["Entry", "Link", "bibliography", "citation_links", "citation_params", "family_of", "fill_template", "fingerprint", "frontmatter", "is_reference_heading", "markdown_links", "name_key", "parse_citation_url", "parse_entry", "without_lines"]
