"""HTML tree to GitHub-flavoured Markdown: ATX headings, "-" bullets, fenced code, pipe tables."""

from __future__ import annotations

import re

from tessella.functions.html import HEADINGS, VOID, Node, parse

_SPACE = re.compile(r"[ \t\r\n\f]+")
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody thead tfoot tr td th ul".split())
#: Characters with a meaning in Markdown, escaped in text.
_ESCAPE = re.compile(r"([\\*_`\[\]])")
_LINE_START = re.compile(r"^(\s*)(#{1,6} |[-+>] |=+$|(\d+)\. )", re.M)


def _escape(text: str) -> str:
    text = _ESCAPE.sub(r"\\\1", text)
    return _LINE_START.sub(lambda m: m[1] + (m[3] + "\\. " if m[3] else "\\" + m[2]), text)


def _inline(node: Node | str) -> str:
    if isinstance(node, str):
        return _escape(_SPACE.sub(" ", node))
    inner = "".join(map(_inline, node.children)) if node.tag not in ("code", "kbd", "samp") else ""
    tag = node.tag
    if tag == "br":
        return "  \n"
    if tag == "img":
        src, alt, title = node.attrs.get("src", ""), node.attrs.get("alt", ""), node.attrs.get("title")
        return f"![{_SPACE.sub(' ', alt)}]({src}{f' "{title}"' if title else ''})" if src else ""
    if tag in ("code", "kbd", "samp"):
        t = _SPACE.sub(" ", node.text())
        fence = "`" * (max([0, *map(len, re.findall("`+", t))]) + 1)
        return f"{fence}{t}{fence}" if t.strip() else ""
    if tag == "input":
        return ("[x] " if "checked" in node.attrs else "[ ] ") if node.attrs.get("type") == "checkbox" else ""
    if tag in ("strong", "b", "em", "i", "del", "s", "strike"):
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*"}.get(tag, "~")
        core = inner.strip()
        return inner if not core else inner[: len(inner) - len(inner.lstrip())] + mark + core + mark + inner[len(inner.rstrip()) :]
    if tag == "a":
        href = node.attrs.get("href")
        if not node.text().strip() and not any(x.tag == "img" for x in node.walk()):
            return ""
        if href is None:
            return inner
        title = node.attrs.get("title")
        return f"[{inner.strip()}]({href}{f' "{title}"' if title else ''})"
    if tag in _BLOCK:
        return "\n\n" + _block(node) + "\n\n"
    return inner


def _flow(children: list) -> str:
    """Blocks apart by a blank line, inline runs joined."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = re.sub(r"[ \t]*\n[ \t]*\n\s*", "\n\n", re.sub(r"(?<! )[ ]{2,}(?!\n)", " ", "".join(run)))
        run.clear()
        if t.strip():
            out.append(t.strip())

    for c in children:
        if not isinstance(c, str) and c.tag in _BLOCK:
            flush()
            if t := _block(c):
                out.append(t)
        else:
            run.append(_inline(c))
    flush()
    return "\n\n".join(out)


def _indent(text: str, by: str) -> str:
    return "\n".join(by + line if line else line for line in text.split("\n"))


def _list(node: Node) -> str:
    lines, n = [], int(node.attrs["start"]) if node.attrs.get("start", "").isdigit() else 1
    for c in node.children:
        if isinstance(c, str) and not c.strip():
            continue
        mark = f"{n}.  " if node.tag == "ol" else "-   "
        n += 1
        body = _flow(c.children if not isinstance(c, str) and c.tag == "li" else [c])
        body = re.sub(r"\n\n(?=\s*(?:-   |\d+\.  ))", "\n", body)
        lines.append((mark + _indent(body, "    ")[4:]).rstrip())
    return "\n".join(lines)


def _table(node: Node) -> str:
    rows = [[_SPACE.sub(" ", _flow(c.children)).replace("|", "\\|").strip() for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] for r in node.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    first = next(r for r in node.all("tr") if any(not isinstance(c, str) and c.tag in ("td", "th") for c in r.children))
    head = all(c.tag == "th" for c in first.children if not isinstance(c, str) and c.tag in ("td", "th"))
    wide = max(map(len, rows))
    rows = [r + [""] * (wide - len(r)) for r in rows]
    if not head:
        rows.insert(0, [""] * wide)
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * wide, *rows[1:]])


def _block(node: Node) -> str:
    tag = node.tag
    if tag in HEADINGS:
        t = _SPACE.sub(" ", _flow(node.children)).strip()
        return f"{'#' * int(tag[1])} {t}" if t else ""
    if tag == "hr":
        return "* * *"
    if tag == "pre":
        code = next((x for x in node.walk() if x.tag == "code"), node)
        lang = re.search(r"(?:language|lang)-(\S+)", code.attrs.get("class", ""))
        t = code.text().rstrip("\n")
        fence = "`" * max(3, max([0, *map(len, re.findall("(?m)^`{3,}", t))]) + 1)
        return f"{fence}{lang[1] if lang else ''}\n{t}\n{fence}"
    if tag == "blockquote":
        t = _flow(node.children)
        return "\n".join("> " + line if line else ">" for line in t.split("\n")) if t else ""
    if tag in ("ul", "ol"):
        return _list(node)
    if tag == "table":
        return _table(node)
    return _flow(node.children)


def to_markdown(node: Node) -> str:
    """Markdown of an element's content."""
    return re.sub(r"\n{3,}", "\n\n", _flow(node.children)).strip()


def html_to_markdown(source: str) -> str:
    """ST14: of an HTML text, without scripts and styles."""
    doc = parse(source)
    for x in doc.all("script, style, noscript, iframe"):
        x.remove()
    return to_markdown(doc.first("body"))


def serialise(node: Node | str) -> str:
    """HTML of a node."""
    import html as h

    if isinstance(node, str):
        return h.escape(node, quote=False)
    attrs = "".join(f' {k}="{h.escape(v).replace("&#x27;", chr(39)).replace("&lt;", "<").replace("&gt;", ">")}"' for k, v in node.attrs.items())
    if node.tag in VOID:
        return f"<{node.tag}{attrs}>"
    raw = node.tag in ("script", "style")
    return f"<{node.tag}{attrs}>" + "".join(c if raw and isinstance(c, str) else serialise(c) for c in node.children) + f"</{node.tag}>"


def inner_html(node: Node) -> str:
    return "".join(map(serialise, node.children))
