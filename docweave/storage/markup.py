"""A compact Markdown to HTML converter: headings, paragraphs, lists, quotes, tables, rules, emphasis, links, images.

Code never reaches it: callers hide code first. Unknown HTML passes through.
"""

from __future__ import annotations

import re

from ..text.lines import RULE, UNDERLINE

_ITEM = re.compile(r"^(?P<pad> *)(?P<mark>[-*+]|\d+[.)])[ \t]+(?P<body>.*)$")
_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_MARKS = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_BLOCK_TAG = re.compile(r"^\s*</?(?:div|p|table|thead|tbody|tr|td|th|ul|ol|li|pre|blockquote|h[1-6]|hr|details|summary|figure|ac:[\w-]+|ri:[\w-]+)\b", re.I)


def inline(text: str) -> str:
    """Emphasis, links, images, autolinks and breaks; bare ampersands and angle brackets become entities."""
    held: list[str] = []

    def hold(value: str) -> str:
        held.append(value)
        return f"\ue002{len(held) - 1}\ue003"

    text = re.sub(r"\\([\\`*_{}\[\]()#+.!>~|-])", lambda m: hold(m[1]), text)
    text = re.sub(r"<!--.*?-->|</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>", lambda m: hold(m[0]), text, flags=re.S)
    text = re.sub(r"<((?:https?|mailto):[^<>\s]+)>", lambda m: hold(f'<a href="{m[1]}">{m[1]}</a>'), text)
    text = re.sub(r"&(?!#\d+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)", "&amp;", text).replace("<", "&lt;")
    text = re.sub(r"!\[([^\]]*)\]\(((?:[^()\s]|\([^()]*\))+)(?:\s+&quot;|\s+\"([^\"]*)\")?\)", lambda m: hold(f'<img src="{m[2]}" alt="{m[1]}"' + (f' title="{m[3]}"' if m[3] else "") + " />"), text)
    link = re.compile(r"\[([^\[\]]*)\]\(<?((?:[^()\s<>]|\([^()]*\))*)>?(?:\s+\"([^\"]*)\")?\)")
    text = link.sub(lambda m: hold(f'<a href="{m[2]}"' + (f' title="{m[3]}"' if m[3] else "") + ">") + m[1] + hold("</a>"), text)
    for mark, tag in (("***", ("<strong><em>", "</em></strong>")), ("**", ("<strong>", "</strong>")), ("__", ("<strong>", "</strong>")), ("*", ("<em>", "</em>")), ("_", ("<em>", "</em>"))):
        m = re.escape(mark)
        edge = (r"(?<![\w])", r"(?![\w])") if mark[0] == "_" else ("", "")
        text = re.sub(rf"{edge[0]}{m}(?=\S)(.+?)(?<=\S){m}{edge[1]}", lambda x, t=tag: t[0] + x[1] + t[1], text, flags=re.S)
    text = re.sub(r" {2,}\n", "<br />\n", text)
    while "\ue002" in text:
        text = re.sub("\ue002(\\d+)\ue003", lambda m: held[int(m[1])], text)
    return text


def _row(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip() for c in re.split(r"(?<!\\)\|", line)]


def _table(lines: list[str]) -> str:
    def cells(line: str, tag: str, align: list[str]) -> str:
        made = (f"<{tag}{a}>{inline(c)}</{tag}>" for c, a in zip(_row(line), align, strict=False))
        return "<tr>" + "".join(made) + "</tr>"

    marks = _row(lines[1])
    align = [' style="text-align:center;"' if m.startswith(":") and m.endswith(":") else ' style="text-align:right;"' if m.endswith(":") else "" for m in marks] + [""] * 99
    body = "\n".join(cells(x, "td", align) for x in lines[2:])
    return f"<table>\n<thead>\n{cells(lines[0], 'th', align)}\n</thead>\n<tbody>\n{body}\n</tbody>\n</table>"


def _list(lines: list[str]) -> str:
    first = _ITEM.match(lines[0])
    base, ordered = len(first["pad"]), first["mark"][0].isdigit()
    items: list[list[str]] = []
    for line in lines:
        m = _ITEM.match(line)
        if m and len(m["pad"]) <= base + 1:
            items.append([m["body"]])
        else:
            pad = min(len(line) - len(line.lstrip()), base + (4 if ordered else 2))
            items[-1].append(line[pad:])
    tag = "ol" if ordered else "ul"
    made = []
    for item in items:
        inner = html("\n".join(item))
        loose = any(not x.strip() for x in item[:-1])
        made.append("<li>" + (inner if loose else re.sub(r"^<p>(.*?)</p>", r"\1", inner, count=1, flags=re.S)) + "</li>")
    return f"<{tag}>\n" + "\n".join(made) + f"\n</{tag}>"


def html(text: str) -> str:
    """Blocks of a Markdown text as HTML, joined by blank lines. Lists may follow a paragraph directly."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _HEAD.match(line):
            level = len(m[1])
            out.append(f"<h{level}>{inline(m[2])}</h{level}>")
            i += 1
        elif RULE.match(line):
            out.append("<hr />")
            i += 1
        elif line.lstrip().startswith(">"):
            k = i
            while k < len(lines) and lines[k].strip():
                k += 1
            inner = "\n".join(re.sub(r"^\s*> ?", "", x) for x in lines[i:k])
            out.append(f"<blockquote>\n{html(inner)}\n</blockquote>")
            i = k
        elif i + 1 < len(lines) and "|" in line and _MARKS.match(lines[i + 1]):
            k = i + 2
            while k < len(lines) and "|" in lines[k] and lines[k].strip():
                k += 1
            out.append(_table(lines[i:k]))
            i = k
        elif _ITEM.match(line):
            k = i + 1
            while k < len(lines):
                blank = not lines[k].strip()
                if blank and not (k + 1 < len(lines) and (lines[k + 1].startswith("  ") or _ITEM.match(lines[k + 1]))):
                    break
                if not blank and not lines[k].startswith(" ") and not _ITEM.match(lines[k]) and not lines[k - 1].strip():
                    break
                if not blank and _HEAD.match(lines[k]):
                    break
                k += 1
            out.append(_list(lines[i:k]))
            i = k
        elif _BLOCK_TAG.match(line):
            k = i
            while k < len(lines) and lines[k].strip():
                k += 1
            out.append("\n".join(lines[i:k]))
            i = k
        else:
            k = i + 1
            while k < len(lines) and lines[k].strip() and not (_HEAD.match(lines[k]) or _ITEM.match(lines[k]) or lines[k].lstrip().startswith(">") or UNDERLINE.match(lines[k]) or RULE.match(lines[k])):
                k += 1
            if k < len(lines) and (m := UNDERLINE.match(lines[k])):
                level = 1 if m[1][0] == "=" else 2
                out.append(f"<h{level}>{inline(' '.join(x.strip() for x in lines[i:k]))}</h{level}>")
                k += 1
            else:
                out.append("<p>" + inline("\n".join(x.lstrip() for x in lines[i:k])).rstrip() + "</p>")
            i = k
    return "\n\n".join(out)
