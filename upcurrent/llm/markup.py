"""Markup residue in text documents: HTML, Markdown, wiki and LaTeX mixed in one text.

One pass strips the markup and notes each syntax it had to strip, so what counts as used is exactly what was removed. Code blocks come
first: their fences are markup, what stands inside them is not; bare URLs are kept apart likewise. Structure survives as
blocks: headings, list items, quotes, code, table rows, formulas and text.

Which prose is content is then decided by line-block distribution: text lengths of the stripped lines are summed over a
sliding window of WINDOW lines; where the sum rises from nothing to at least SURGE characters a part begins, where it
falls back to nothing it ends, and text between is kept. Lines that carry structure are kept wherever they stand, and so is a short
line that is a whole sentence; lines that were nothing but markup have no text and leave. A text without any surge is kept whole. How much
prose was left out is counted.

Null and blank texts use no syntax and give an empty text. Markup cut off at the end of a text counts if its opening is
unmistakable. Texts are read whole, and markup may have any length: patterns stop at what cannot stand inside them, and delimiters are paired by
one scan (paired), so that a line without any end to its markup costs no more than one with it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread

WINDOW = 3
SURGE = 20

#: Element names of HTML that texts use.
TAGS = """a abbr address area article aside audio b base bdi bdo blockquote body br button caption center cite code col
colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6
head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav object ol optgroup
option output p picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub
summary sup table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr""".split()

HEAD, ITEM, CELL, CODE = "\ue100", "\ue101", "\ue102", "\ue103"
_OURS = re.compile("[\ue100-\ue10f]")
_ATTRIBUTES = r"""(?:\s+(?:[\w:.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+)|open|checked|disabled|hidden|controls|nowrap|selected))*\s*/?"""
_TAG = re.compile(r"<(/?)(" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(" + _ATTRIBUTES + r")>", re.I)
_OPEN_TAG_AT_END = re.compile(r"<(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")\s+[\w:-]+\s*=\s*[\"'][^<>\n]*\Z|</(?:" + "|".join(TAGS) + r")\Z", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)", re.S | re.I)
_CODE_TAG = re.compile(r"<(/?)(code|kbd|samp|tt)\b[^<>]*>", re.I)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_WIKI_TAG = re.compile(r"<(nowiki|syntaxhighlight|source|ref|gallery|math)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_URL = re.compile(r"\b(?:https?|ftp|git|ssh)://[^\s<>\"'`\])}|]+[^\s<>\"'`\])}|.,;:!?]")

_FENCE = re.compile(r"^\s{0,3}(?:>\s?)?(`{3,}|~{3,})\s*([\w+.#-]*)[^`]*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*)$")
_SETEXT = re.compile(r"^ {0,3}(=+|-{2,})\s*$")
_RULE_ROW = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|\s*:?-{3,}:?\s*\|\s*$")
_LIST = re.compile(r"^(\s*)([-*+]|\d{1,3}[.)])[ \t]+(\[[ xX]\][ \t]+)?(\S.*)$")
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
_NOTE = re.compile(r"^ {0,3}\[\^[^\]\s]+\]:\s*(.*)$")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]^\n]+)\]:\s+<?(?:https?://|/|#|mailto:)\S*.*$")
_IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)")
_LINK = re.compile(r"(?<![\]\\!A-Za-z0-9_])\[([^\[\]\n]+)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"\n]*\")?\)")
_LINK_AT_END = re.compile(r"(?<![A-Za-z0-9_\]])!?\[([^\[\]\n]+)\]\((?:[a-z#/.][^\s()]*)?\Z")
_REF_LINK = re.compile(r"(?<!\])\[([^\[\]\n]{2,})\]\[([^\[\]\n]*)\]")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_NOTE_REF = re.compile(r"\[\^[^\[\]\s]+\]")
_TICKS = re.compile(r"(?<![`\\])(`{1,2})(?!`)([^`\n]+?)(?<!`)\1(?!`)")
_STRONG = re.compile(r"(?<![\w*\\/])\*\*(?=[^\s*])([^*\n]+?)(?<=\S)\*\*(?![\w*])|(?<![\w_\\/])__(?=[^\s_])([^_\n]+)(?<=\S)__(?![\w_])")
_NO_WORD = re.compile(r"\W")
_STRIKE = re.compile(r"(?<![~\w])~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)")
_EM = re.compile(r"(?<![\w*\\/.])\*(?=[\w\"'(])([^*\n]+?)(?<=[\w.!?\"')])\*(?![\w*/.])|(?<![\w\\/.])_(?=[\w\"'(])(?!_)([^_\n]+?)(?<=[\w.!?\"')])_(?![\w/.(])")

_JIRA_HEAD = re.compile(r"^\s*h([1-6])\.[ \t]+(\S.*)$")
_WIKI_ITALIC = re.compile(r"(?<!['\w])''(?=[^\s'])([^'\n]+?)(?<=[^\s'])''(?!['\w])")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
_JIRA_LINK = re.compile(r"(?<![\[\w])\[([^\[\]|\n]+)\|((?:https?://|mailto:|#|\^|~)[^\[\]\n]*)\]")
_SITE_LINK = re.compile(r"(?<![\[\w\]])\[(?:https?|ftp)://[^\s\]]+\s+([^\[\]\n]+)\](?!\()")
_TEMPLATE = re.compile(r"\{\{(?:([A-Z#][^\s{}|][^{}|\n]*|[A-Z])(\|[^{}]*)?|([a-z][\w -]*)(\|[^{}]*))\}\}")
_WIKI_CODE = re.compile(r"^\s*(\{\{\{|\{(?:code|noformat)(?::[^}\n]*)?\})")
_WIKI_CODE_MARK = re.compile(r"\{(?:code|noformat)(:[^{}\n]*)?\}")
_JIRA_ROW = re.compile(r"^\s*\|\|.+\|\|\s*$")
_CREOLE_ROW = re.compile(r"^\s*\|=.+")
_PIPE_ROW = re.compile(r"^\s*\|.*\|\s*$")

_SECTION = re.compile(r"\\((?:sub){0,2}section|chapter|paragraph|title)\*?\{([^{}\n]*)\}?")
_BEGIN = re.compile(r"\\(begin|end)\{([a-zA-Z]+\*?)\}(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})?")
_BEGIN_AT_END = re.compile(r"\\(?:begin|end)\{[a-zA-Z]*\Z")
_COMMAND = re.compile(r"\\(?:text(?:bf|it|tt|sc|rm|sf|sl|md|up)?|emph|underline|cite[pt]?|ref|eqref|label|footnote|href|url|caption|mbox|includegraphics|usepackage|documentclass|bf|it|tt|item)\b\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})*")
_COMMAND_ARGUMENT = re.compile(r"\{([^{}]*)\}")
#: Inside a line without a command: tight, or with blanks on both sides.
_DOUBLE = re.compile(r"(?<![\\$\w])\$\$(?:(?![\s$])([^$\n]+?)(?<![\s\\])|[ \t]([^$\n]+?)[ \t])\$\$(?![\w$])")
_SPACED_SIGN = re.compile(r"[\\^]|_\{|\s=\s")
_NO_FORMULA = re.compile(r"\\[dwsbDWSB][+*]?")
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]+?)(?<![\s\\])\$(?![\w$])")
_MATH_SIGN = re.compile(r"[\\^_{}=<>]|^[A-Za-z]'?$|^[A-Za-z]\([^()]*\)$|[A-Za-z]\s*[-+*/]\s*\w")
_MATH_ENVS = {"equation", "align", "gather", "multline", "displaymath", "math", "eqnarray", "alignat", "flalign"}
_CODE_ENVS = {"verbatim", "lstlisting", "minted", "Verbatim"}


#: What a whole sentence looks like, however short it is.
_SENTENCE = re.compile(r"^\W{0,3}\w.*\w\W{0,2}[.!?:。！？][\"')\]»”]{0,2}$")


def _is_reference(name: str) -> bool:
    return name[1] == "#" or name[1:] in html5


def paired(s: str, opening: str, closing: str, inside: Callable[[str], str | None], opens: Callable[[int], bool] = lambda i: True, closes: Callable[[int], bool] = lambda i: True) -> str:
    """s with opening, text and closing replaced by inside(text); None leaves them. opens and closes tell by its place whether a delimiter may.

    A closing one belongs to the last opening one before it, so no character is looked at more than a few times.
    """
    width, n = len(opening), len(closing)
    out, at, i = [], 0, s.find(opening)
    while i >= 0:
        if not opens(i):
            i = s.find(opening, i + 1)
            continue
        j, later = i + width + 1, s.find(opening, i + width)
        while (j := s.find(closing, j)) >= 0 and not closes(j):
            j += 1
        if j < 0:
            break
        while 0 <= later < j - width and (opening != closing or later < j):
            if opens(later):
                i = later
            later = s.find(opening, later + width)
        if j > i + width and (got := inside(s[i + width : j])) is not None:
            out += [s[at:i], got]
            at = j + n
        i = s.find(opening, max(j + (n if at == j + n else 0), i + 1))
    return "".join(out) + s[at:] if out else s


def one_line(formula: str) -> str | None:
    """A formula in a paragraph that runs over several of its lines, with its delimiters."""
    lines = formula.split("\n")
    if len(lines) == 1 or not all(x.strip() for x in lines[1:-1]) or not _MATH_SIGN.search(formula) or _NO_FORMULA.search(formula):
        return None
    return "\\(" + " ".join(x.strip() for x in lines) + "\\)"


def code_marks(s: str, keep: Callable[[str], str]) -> str:
    """s with the code that stands between two marks on one line replaced by what keep gives."""
    if "{{{" in s:
        s = paired(s, "{{{", "}}}", lambda x: None if "\n" in x else keep(x))
    if "{code" in s or "{noformat" in s:
        out, at, first = [], 0, None
        for m in _WIKI_CODE_MARK.finditer(s):
            if first and not m[1] and m.start() > first.end() and "\n" not in s[first.end() : m.start()]:
                out += [s[at : first.start()], keep(s[first.end() : m.start()])]
                at, first = m.end(), None
            else:
                first = m
        s = "".join(out) + s[at:] if out else s
    return s


def code_tags(s: str, keep: Callable[[str], str]) -> str:
    """s with what stands between a code tag and the next end tag of its name replaced."""
    out, at, first = [], 0, None
    for m in _CODE_TAG.finditer(s):
        if not first:
            first = None if m[1] else m
        elif m[1] and m[2].lower() == first[2].lower():
            out += [s[at : first.start()], keep(s[first.end() : m.start()])]
            at, first = m.end(), None
    return "".join(out) + s[at:] if out else s


def wiki_head(s: str) -> tuple[int, str] | None:
    """Level and title of a heading between equal signs."""
    level = len(s) - len(s.lstrip("="))
    if not 1 <= level <= 6 or len(s) <= 2 * level or not s.endswith("=" * level):
        return None
    title = s[level:-level].strip()
    return (level, title) if title and title[0] != "=" else None


def atx_title(s: str) -> str:
    """A heading's text without the signs behind it."""
    s = s.rstrip()
    bare = s.rstrip("#")
    return bare.rstrip() if bare and bare[-1].isspace() else s


class Stripper:
    """Strips one text: found is the set of syntaxes, blocks the list of (kind, text)."""

    def __init__(self, text: str):
        self.found: set[str] = set()
        self.blocks: list[tuple[str, str]] = []
        self.codes: list[str] = []
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "\ue100" <= max(text, default="") :
            text = _OURS.sub(" ", text)
        text = self.code_blocks(text)
        if "\\(" in text and "\\)" in text:
            text = paired(text, "\\(", "\\)", one_line)
        self.lines(text)

    def keep_code(self, code: str, inline: bool = False) -> str:
        self.codes.append(code)
        at = f"{CODE}{len(self.codes) - 1}{CODE}"
        return at if inline else f"\n{at}\n"

    def code_blocks(self, text: str) -> str:
        """Puts marks in place of all code blocks, so that nothing in them is taken for markup."""
        if "```" in text or "~~~" in text or "{{{" in text or "{code" in text or "{noformat" in text or "verbatim" in text or "lstlisting" in text or "minted" in text:
            out, code, stop = [], None, None
            for line in text.split("\n"):
                if code is None:
                    if m := _FENCE.match(line):
                        kind, stop = "markdown", re.compile(rf"^\s*(?:>\s?)?{m[1][0]}{{{len(m[1])},}}\s*$")
                        code = []
                    elif (m := _WIKI_CODE.match(line)) and code_marks(line, lambda x: "") == line:
                        kind, stop = "wiki", re.compile(r"^.*\}\}\}\s*$" if m[1] == "{{{" else r"^.*\{(?:code|noformat)\}\s*$")
                        code = [line[m.end() :]] if line[m.end() :].strip() else []
                    elif (m := _BEGIN.search(line)) and m[1] == "begin" and m[2].rstrip("*") in _CODE_ENVS:
                        kind, stop, code = "latex", re.compile(r"\\end\{" + re.escape(m[2]) + r"\}"), []
                    else:
                        out.append(line)
                        continue
                    self.found.add(kind)
                elif stop.search(line):
                    rest = re.sub(r"(?:\}\}\}|\{(?:code|noformat)\}|\\end\{\w+\*?\}|`{3,}|~{3,})\s*$", "", line)
                    out.append(self.keep_code("\n".join(code + [rest] * bool(rest.strip("> \t")))))
                    code = None
                else:
                    code.append(line)
            if code is not None:
                out.append(self.keep_code("\n".join(code)))
            text = "\n".join(out)
        if "<" in text:
            text = _PRE.sub(self.pre, text)
        if "`" in text:
            text = _TICKS.sub(self.ticks, text)
        if "{" in text and ("{{{" in text or "{code" in text or "{noformat" in text):
            text = code_marks(text, lambda x: (self.found.add("wiki"), self.keep_code(x, True))[1])
        if "<" in text:
            text = self.html(text)
        return text

    def pre(self, m: re.Match) -> str:
        self.found.add("html")
        return self.keep_code(unescape(_TAG.sub("", m[1])).strip("\n"))

    def ticks(self, m: re.Match) -> str:
        self.found.add("markdown")
        return self.keep_code(m[2], True)

    def html(self, text: str) -> str:
        before = text
        text = _WIKI_TAG.sub(lambda m: (self.found.add("wiki"), self.keep_code(m[2], True))[1], text)
        text = _AUTOLINK.sub(lambda m: (self.found.add("markdown"), m[1])[1], text)
        html = _COMMENT.sub("", text)
        html = code_tags(html, lambda x: self.keep_code(unescape(_TAG.sub("", x)), True))
        html = _TAG.sub(self.tag, html)
        html = _OPEN_TAG_AT_END.sub("", html)
        if html != text:
            self.found.add("html")
        return html if before else text

    @staticmethod
    def tag(m: re.Match) -> str:
        close, name = m[1], m[2].lower()
        if name[0] == "h" and name[1:].isdigit():
            return "\n" if close else f"\n{HEAD}{name[1]}"
        if name == "li":
            return "\n" if close else f"\n{ITEM}"
        if name in ("td", "th"):
            return "" if close else CELL
        if name in ("br", "p", "div", "tr", "table", "ul", "ol", "blockquote", "details", "summary", "hr", "section", "dl", "dt", "dd"):
            return "\n"
        return ""

    def lines(self, text: str) -> None:
        raw = text.split("\n")
        table_rows = {k for k, x in enumerate(raw) if "-" in x and "|" in x and _RULE_ROW.match(x) and k and "|" in raw[k - 1]}
        closing = {end: [k for k, x in enumerate(raw) if end in x] if end in text else [] for end in ("$$", "\\]")}
        closing["\\["] = [k for k, x in enumerate(raw) if x.strip().startswith("\\[") or x.rstrip().endswith("\\[")] if closing["\\]"] else []
        in_wiki_table, in_math, math, skip = False, "", [], False
        until, after = -1, ""
        for k, line in enumerate(raw):
            if k < until:
                continue
            s = line.strip()
            if k == until:
                s = line = after
                if not s:
                    continue
            if in_math:
                if (m := _BEGIN.search(line)) and m[1] == "end":
                    self.blocks.append(("formula", "\n".join(math)))
                    in_math, math = "", []
                else:
                    math.append(s)
                continue
            if not s:
                self.blocks.append(("blank", ""))
                continue
            c = s[0]
            if c == CODE and s.count(CODE) == 2 and s[-1] == CODE:
                self.blocks.append(("code", self.codes[int(s[1:-1])]))
                continue
            if c == HEAD:
                self.blocks.append(("heading", "#" * int(s[1]) + " " + self.inline(s[2:])))
                continue
            if c == ITEM:
                self.blocks.append(("list", "- " + self.inline(s[1:].strip())))
                continue
            if CELL in s:
                self.blocks.append(("table", " | ".join(self.inline(x.strip()) for x in s.split(CELL) if x.strip())))
                continue
            # Wiki tables, headings and code.
            if s.startswith("{|"):
                self.found.add("wiki")
                in_wiki_table = True
                continue
            if in_wiki_table:
                if s.startswith("|}"):
                    in_wiki_table = False
                elif not s.startswith("|-") and c in "|!":
                    self.blocks.append(("table", " | ".join(self.inline(x.strip()) for x in re.split(r"\|\||!!", s[1:]))))
                elif not s.startswith("|-"):
                    self.blocks.append(("text", self.inline(s)))
                continue
            if c == "|" and (_JIRA_ROW.match(line) or _CREOLE_ROW.match(line)):
                self.found.add("wiki")
                self.blocks.append(("table", " | ".join(self.inline(x.strip("= \t")) for x in s.strip("|").split("||" if "||" in s else "|"))))
                continue
            if c == "=" and (head := wiki_head(s)) and not _SETEXT.match(line):
                self.found.add("wiki")
                self.blocks.append(("heading", "#" * head[0] + " " + self.inline(head[1])))
                continue
            if c == "h" and (m := _JIRA_HEAD.match(line)):
                self.found.add("wiki")
                self.blocks.append(("heading", "#" * int(m[1]) + " " + self.inline(m[2])))
                continue
            # LaTeX lines.
            if (c == "$" or "\\[" in s) and (block := self.display(raw, k, s, closing)):
                before, formula, after, until = block
                self.found.add("latex")
                if before:
                    self.blocks.append(("text", self.inline(before)))
                self.blocks.append(("formula", formula))
                continue
            if c == "\\":
                if m := _SECTION.match(s):
                    self.found.add("latex")
                    self.blocks.append(("heading", "#" * (1 + m[1].count("sub")) + " " + self.inline(m[2])))
                    rest = s[m.end() :].strip()
                    if rest:
                        self.blocks.append(("text", self.inline(rest)))
                    continue
                if m := _BEGIN.match(s):
                    self.found.add("latex")
                    rest = s[m.end() :].strip()
                    if m[1] == "begin" and m[2].rstrip("*") in _MATH_ENVS:
                        if e := _BEGIN.search(rest):
                            self.blocks.append(("formula", rest[: e.start()].strip()))
                        else:
                            in_math, math = m[2], [rest] * bool(rest)
                    elif rest:
                        self.blocks.append(("text", self.inline(rest)))
                    continue
                if s.startswith("\\item"):
                    self.found.add("latex")
                    self.blocks.append(("list", "- " + self.inline(re.sub(r"^\\item\s*(?:\[([^\]\n]*)\])?\s*", "", s))))
                    continue
            if c == "$" and s.startswith("$$") and len(s) > 4 and s.endswith("$$"):
                self.found.add("latex")
                self.blocks.append(("formula", s.strip("$ ")))
                continue
            # Markdown lines.
            if k in table_rows:
                self.found.add("markdown")
                continue
            if "|" in s and (k + 1 in table_rows or c == "|" and any(j in table_rows for j in range(max(0, k - 1), k)) or self.blocks and self.blocks[-1][0] == "table" and _PIPE_ROW.match(line)):
                self.blocks.append(("table", " | ".join(self.inline(x.strip()) for x in s.strip("|").split("|"))))
                continue
            if c in "=-" and (m := _SETEXT.match(line)) and self.blocks and self.blocks[-1][0] == "text" and len(m[1]) >= 3:
                self.found.add("markdown")
                self.blocks[-1] = ("heading", ("# " if m[1][0] == "=" else "## ") + self.blocks[-1][1])
                continue
            if c == "#" and (m := _ATX.match(line)):
                self.found.add("markdown")
                self.blocks.append(("heading", m[1] + " " + self.inline(atx_title(m[2]))))
                continue
            if c == ">" and (m := _QUOTE.match(line)) and not re.match(r"[=>\d]", m[1][:1] or " "):
                self.found.add("markdown")
                self.blocks.append(("quote", self.inline(m[1])))
                continue
            if c == "[":
                if m := _NOTE.match(line):
                    self.found.add("markdown")
                    self.blocks.append(("text", self.inline(m[1])))
                    continue
                if _DEFINITION.match(line):
                    self.found.add("markdown")
                    continue
            if (c in "-*+" or c.isdigit()) and (m := _LIST.match(line)):
                self.found.add("markdown")
                self.blocks.append(("list", (m[2] if m[2][0].isdigit() else "-") + " " + (m[3] or "") + self.inline(m[4])))
                continue
            self.blocks.append(("text", self.inline(s)))
        if math:
            self.blocks.append(("formula", "\n".join(math)))

    @staticmethod
    def display(raw: list[str], k: int, s: str, closing: dict[str, list[int]]) -> tuple[str, str, str, int] | None:
        """Text before, formula, text behind and last line of a formula that opens in line k, at its start or end, and closes in a later one."""
        if s.startswith("$$"):
            end, before, first = "$$", "", s[2:]
        elif s.startswith("\\[") or s.endswith("\\["):
            end, at = "\\]", 0 if s.startswith("\\[") else len(s) - 2
            before, first = s[:at].strip(), s[at + 2 :]
        else:
            return None
        at = bisect_right(closing[end], k)
        if end in first or at == len(closing[end]):
            return None
        if end != "$$" and bisect_right(closing["\\["], closing[end][at] - 1) > bisect_right(closing["\\["], k):
            return None  # it opens anew before it closes
        last = raw[closing[end][at]]
        inside, _, after = last.partition(end)
        if end == "$$" and inside.strip() and after.strip():
            return None
        formula = "\n".join(x for x in (first.strip(), *(x.strip() for x in raw[k + 1 : closing[end][at]]), inside.strip()) if x)
        if not _MATH_SIGN.search(formula) or end != "$$" and _NO_FORMULA.search(formula):
            return None
        return before, formula, after.strip(), closing[end][at]

    def inline(self, s: str) -> str:
        found = self.found
        urls: list[str] = []
        if "](" in s:
            t = _LINK.sub(r"\1", _IMAGE.sub(r"\1", s))
            t = _LINK_AT_END.sub(r"\1", t)
            if t != s:
                found.add("markdown")
            s = t
        if "[" in s:
            t = _NOTE_REF.sub("", s) if "[^" in s else s
            t = _REF_LINK.sub(r"\1", t) if "][" in t else t
            if t != s:
                found.add("markdown")
            s = t
            if "[[" in s:
                s = _WIKI_LINK.sub(self.wiki_link, s)
            if "|" in s or "://" in s:
                t = _SITE_LINK.sub(r"\1", _JIRA_LINK.sub(r"\1", s))
                if t != s:
                    found.add("wiki")
                s = t
        if "://" in s:
            s = _URL.sub(lambda m: (urls.append(m[0]), f"\ue104{len(urls) - 1}\ue104")[1], s)
        if "{{" in s:
            t = _TEMPLATE.sub(lambda m: (m[2] or m[4] or m[1] or "").lstrip("|").replace("|", " "), s)
            if t != s:
                found.add("wiki")
            s = t
        if "''" in s:
            t = paired(s, "'''", "'''", lambda x: x, lambda i: not s[i + 3 : i + 4].isspace() and i + 3 < len(s), lambda i: not s[i - 1].isspace()) if "'''" in s else s
            t = _WIKI_ITALIC.sub(r"\1", t)
            if t != s:
                found.add("wiki")
            s = t
        if "\\" in s:
            t = paired(s, "\\(", "\\)", lambda x: x.strip() if x.strip() and _MATH_SIGN.search(x) else None)
            t = paired(t, "$$", "$$", str.strip)
            t = paired(t, "\\[", "\\]", lambda x: x.strip() if _MATH_SIGN.search(x.strip()) and not _NO_FORMULA.search(x) else None)
            t = _SECTION.sub(r"\2", t)
            t = _BEGIN_AT_END.sub("", _BEGIN.sub("", t))
            t = _COMMAND.sub(lambda m: " ".join(_COMMAND_ARGUMENT.findall(m[0])) if "{" in m[0] else m[0], t)
            if t != s:
                found.add("latex")
            s = t
        if "$" in s:
            t = s
            if "$$" in s:
                t = _DOUBLE.sub(lambda m: m[1] or m[2].strip() if (_MATH_SIGN.search(m[1]) if m[1] else _SPACED_SIGN.search(m[2])) else m[0], s)
            t = _DOLLAR.sub(lambda m: m[1] if _MATH_SIGN.search(m[1].strip()) else m[0], t)
            if t != s:
                found.add("latex")
            s = t
        if "*" in s or "_" in s or "~~" in s:
            t = _STRONG.sub(lambda m: m[1] or (m[2] if _NO_WORD.search(m[2]) else m[0]), s)
            t = _STRIKE.sub(r"\1", t)
            t = _EM.sub(lambda m: m[1] or m[2], t)
            if t != s:
                found.add("markdown")
            s = t
        if "&" in s:
            t = _REFERENCE.sub(lambda m: unescape(m[0]) if _is_reference(m[0]) else m[0], s)
            if t != s:
                found.add("html")
            s = t
        if urls:
            s = re.sub("\ue104(\\d+)\ue104", lambda m: urls[int(m[1])], s)
        if CODE in s:
            s = re.sub(f"{CODE}(\\d+){CODE}", lambda m: "`" + self.codes[int(m[1])] + "`", s)
        return s

    def wiki_link(self, m: re.Match) -> str:
        page, label = m[1], m[2]
        # [[tool.sources]] heads a TOML table, [[ -f x ]] tests a file: a page has a capital, a blank or a label.
        if label is None and (page != page.strip() or not (re.search(r"[A-Z ]", page[1:]) or page[0].isupper()) or re.fullmatch(r"[\w.-]+\.[\w.-]+", page)):
            return m[0]
        self.found.add("wiki")
        return label or page

    def text(self) -> str:
        """The blocks that line-block distribution keeps, as text. Sets left_out, the characters of prose it does not keep."""
        lengths = [len(t) if kind != "blank" else 0 for kind, t in self.blocks]
        kept = keep(lengths)
        self.left_out = 0
        out: list[str] = []
        for (kind, t), k in zip(self.blocks, kept):
            if kind == "blank":
                if out and out[-1]:
                    out.append("")
            elif kind == "code":
                out.append("```\n" + t + "\n```")
            elif kind == "formula":
                out.append("$$ " + t + " $$")
            elif kind == "quote":
                out.append("> " + t)
            elif t.strip():
                if k or kind != "text" or _SENTENCE.match(t.strip()):
                    out.append(t)
                else:
                    self.left_out += len(t)
        return "\n".join(out).strip("\n")


def keep(lengths: list[int]) -> list[bool]:
    """Line-block distribution: which lines lie between a surge of the windowed text length and the next dive."""
    n = len(lengths)
    sums = [sum(lengths[k : k + WINDOW]) for k in range(n)]
    if max(sums, default=0) < SURGE:
        return [x > 0 for x in lengths]
    out, inside = [False] * n, False
    for k in range(n):
        if not inside and sums[k] >= SURGE:
            inside = True
        elif inside and sums[k] == 0:
            inside = False
        out[k] = inside or lengths[k] > 0 and any(sums[max(0, k - WINDOW + 1) : k + 1]) and sum(lengths[max(0, k - WINDOW + 1) : k + 1]) >= SURGE
    return out


SYNTAXES = ("html", "latex", "markdown", "wiki")


def syntaxes(text: str | None) -> list[str]:
    return sorted(Stripper(text).found) if text and not text.isspace() else []


KINDS = ("heading", "list", "code", "table", "formula")
CLEANED = "id bigint, markup array<string>, clean string, " + ", ".join(f"n_{k} int" for k in KINDS) + ", left_out bigint"


def clean_text(rows: DataFrame, row_id: str = "id", text: str = "body") -> DataFrame:
    """CLEANED of every row: the syntaxes its text uses, the text without them, its structure counted, and the characters of prose left out; nulls give an empty text."""
    schema = pa.schema([("id", pa.int64()), ("markup", pa.list_(pa.string())), ("clean", pa.string()), *((f"n_{k}", pa.int32()) for k in KINDS), ("left_out", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                found, cleaned, counts, lost = [], [], [[] for _ in KINDS], []
                for t in batch.column(1).to_pylist():
                    s = Stripper(t) if t and not t.isspace() else None
                    cleaned.append(s.text() if s else "")
                    found.append(sorted(s.found) if s else [])
                    lost.append(s.left_out if s else 0)
                    kinds = [b[0] for b in s.blocks] if s else []
                    for c, k in zip(counts, KINDS):
                        c.append(kinds.count(k))
                columns = [batch.column(0), found, cleaned, *counts, lost]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, schema.types)], schema=schema)

    return spread(rows.select(F.col(row_id).cast("bigint"), F.col(text))).mapInArrow(run, CLEANED)


def used_markup(rows: DataFrame, row_id: str = "id", text: str = "body") -> DataFrame:
    """id, markup: one row for each syntax that had to be taken out of a text."""
    return clean_text(rows.where(F.col(text).isNotNull()), row_id, text).select("id", F.explode("markup").alias("markup"))
