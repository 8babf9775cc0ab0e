"""The sender's own new wording of a raw email message.

One pass over headers and body with compiled patterns; nothing is looked up outside the message. Of a multipart body
the first plain-text form counts, else the HTML form; attachments never do. Transfer encodings and character sets
are undone as far as they can be. Then quoted and forwarded text, signatures and disclaimers are left out by their marks.

Defined results: null, empty or blank text gives ''. A message without a blank line after its headers is taken
for a body if its first line is no header. Broken encodings are decoded as far as they go.
"""

from __future__ import annotations

import binascii
import html
import re

_HEADER = re.compile(r"[!-9;-~]+:")
_TYPE = re.compile(r"^content-type[ \t]*:[ \t]*([^;\s]*)", re.I | re.M)
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"\n]+)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([\w.:-]+)", re.I)
_CODING = re.compile(r"^content-transfer-encoding[ \t]*:[ \t]*([\w-]+)", re.I | re.M)
_ATTACHED = re.compile(r"^content-disposition[ \t]*:[ \t]*attachment", re.I | re.M)
_FOLD = re.compile(r"\n[ \t]+")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_UNSEEN = re.compile(r"<(style|script|head|blockquote)\b.*?</\1\s*>", re.I | re.S)
_BREAKS = re.compile(r"<(?:br|/tr|/li)\b[^>]*>", re.I)
_ENDS = re.compile(r"</(?:p|div|h\d|table|ul|ol)\b[^>]*>", re.I)
_TAGS = re.compile(r"<[^<>]*>|<!--.*?-->", re.S)


def _bytes_to_text(data: bytes, charset: str | None) -> str:
    """UTF-8 wherever it fits, whatever is declared; else the declared set; else the common western one."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    for name in (charset, "cp1252"):
        if name and name.lower() not in ("utf-8", "utf8"):
            try:
                return data.decode(name)
            except (UnicodeDecodeError, LookupError, ValueError):
                continue
    return data.decode("latin-1")


def _undo(body: str, coding: str, charset: str | None) -> str:
    if coding == "base64":
        packed = _NOT_BASE64.sub("", body.split("\n\n--", 1)[0])
        packed = packed[: len(packed) // 4 * 4] if len(packed) % 4 == 1 else packed + "=" * (-len(packed) % 4)
        try:
            return _bytes_to_text(binascii.a2b_base64(packed), charset)
        except binascii.Error:
            return body
    if coding == "quoted-printable":
        return _bytes_to_text(binascii.a2b_qp(body.encode("utf-8", "surrogatepass")), charset)
    return body


def _from_html(text: str) -> str:
    text = _UNSEEN.sub("\n", text)
    text = _ENDS.sub("\n\n", _BREAKS.sub("\n", text.replace("<br>\n", "<br>")))
    return html.unescape(_TAGS.sub("", text))


def _entity(text: str) -> tuple[str, str]:
    """Headers and body of a message or part."""
    if text.startswith("\n"):
        return "", text[1:]
    head, found, body = text.partition("\n\n")
    if not found and not _HEADER.match(head):
        return "", text
    return _FOLD.sub(" ", head), body


def _forms(head: str, body: str, depth: int, found: dict[str, str]) -> None:
    """Collect the first plain and the first HTML form of an entity."""
    kind = _TYPE.search(head)
    kind = kind.group(1).lower() if kind else "text/plain"
    if _ATTACHED.search(head):
        return
    if kind.startswith("multipart/"):
        line = head[_TYPE.search(head).start() :].partition("\n")[0]
        mark = _BOUNDARY.search(line) or _BOUNDARY.search(head)
        if mark and depth < 8:
            for part in re.split(r"(?:^|\n)--" + re.escape(mark.group(1) or mark.group(2)) + r"(?:--)?[ \t]*(?:\n|\Z)", body)[1:]:
                _forms(*_entity(part), depth + 1, found)
                if "plain" in found:
                    return
        elif "plain" not in found:
            found["plain"] = body
        return
    name = "plain" if kind in ("text/plain", "text", "") else "html" if kind == "text/html" else None
    if name and name not in found:
        charset = _CHARSET.search(head)
        coding = _CODING.search(head)
        text = _undo(body, coding.group(1).lower() if coding else "", charset.group(1) if charset else None).replace("\r\n", "\n")
        text = _from_html(text) if name == "html" else text
        if text.strip():
            found[name] = text


def body_text(message: str | None) -> str:
    if not message or not message.strip():
        return ""
    found: dict[str, str] = {}
    _forms(*_entity(message.replace("\r\n", "\n").lstrip("\n")), 0, found)
    return found.get("plain") or found.get("html") or ""


_QUOTED = re.compile(r"\s{0,3}[>|]")
_COLON = re.compile(r"\s{0,3}:(?:\s|$|[>|:])")
_RULE = re.compile(r"\s*(?:-{4,} ?\S.*\S ?-{4,}|_{20,}|begin forwarded message:|anfang der weitergeleiteten.*:|début du message.*:|inicio del mensaje.*:)\s*$", re.I)
_FIELD = re.compile(r"\s*\*?(?:from|von|de|sent|gesendet|envoyé|enviado|to|an|à|para|subject|betreff|objet|asunto)\s?:", re.I)
_BY = re.compile(r"(?:\bwrote|\bwrites|\bschrieb|\ba écrit|\bescribió)\b.{0,80}:\s*$")
_DAY = re.compile(r"\b\d{1,2} \w{3,4}\.? \d{4}|\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}")
_LEAD = re.compile(r"\s*(?:on|am|le|el) \d", re.I)
_SIGNED = re.compile(r"\s*--\s*$")
_LONGEST = 110  # characters of a line that introduces a quotation
_STARS = re.compile(r"\s*\*{3,}")


def own_text(body: str) -> str:
    """What the sender wrote anew, line by line."""
    lines = body.split("\n")
    kept: list[str] = []
    colon_block = False  # within a quotation marked by ':'
    n = len(lines)
    at = 0
    while at < n:
        line = lines[at]
        if not line.strip():
            kept.append("")
            colon_block = False
            at += 1
            continue
        if _QUOTED.match(line):
            at += 1
            continue
        before = kept[-1] if kept else ""
        if _COLON.match(line) and (colon_block or not before.strip()):
            colon_block = True
            at += 1
            continue
        colon_block = False
        if _SIGNED.match(line) or _STARS.match(line):
            break  # a signature or notice ends the wording; what may follow below it is quoted or more of it
        if _RULE.match(line) or (_FIELD.match(line) and at + 1 < n and _FIELD.match(lines[at + 1])):
            break
        # "On <day>, <name> wrote:" may be folded over two or three lines.
        joined, used = line, 1
        if len(line) <= _LONGEST and (_LEAD.match(line) or "@" in line or _DAY.search(line)):
            while used < 3 and not _BY.search(joined) and at + used < n and 0 < len(lines[at + used].strip()) <= _LONGEST and not _QUOTED.match(lines[at + used]):
                joined += " " + lines[at + used].strip()
                used += 1
            if _BY.search(joined) and (_DAY.search(joined) or "@" in joined):
                kept.append("")
                at += used
                colon_block = at < n and bool(_COLON.match(lines[at]))
                continue
        kept.append(line)
        at += 1
    return "\n".join(kept)


def own_wording(message: str | None) -> str:
    return own_text(body_text(message))


_SUBJECT = re.compile(r"^subject[ \t]*:[ \t]*(.*)$", re.I | re.M)
_WORD_CODE = re.compile(r"=\?([\w-]+)\?([bq])\?([^?]*)\?=", re.I)
_PREFIX = re.compile(r"^(?:\s*\w{1,4}(?:\[\d+\])?\s*:)+\s*")


def subject_line(message: str | None) -> str:
    """The decoded subject line without reply and forward marks."""
    if not message:
        return ""
    found = _SUBJECT.search(_head(message))
    if not found:
        return ""

    def plain(m: re.Match) -> str:
        try:
            data = binascii.a2b_base64(m.group(3)) if m.group(2) in "bB" else binascii.a2b_qp(m.group(3).encode("ascii", "replace"), header=True)
        except binascii.Error:
            return m.group(0)
        return _bytes_to_text(data, m.group(1))

    return _PREFIX.sub("", _WORD_CODE.sub(plain, found.group(1))).strip()


_ROUTE = re.compile(r"^(from|to|cc|reply-to|sender|delivered-to|list-id|list-post|newsgroups|x-folder)[ \t]*:(.*)$", re.I | re.M)
_ADDRESS = re.compile(r"([\w.+'-]+)@([\w.-]+\w)|<([\w-]+)\.([\w.-]+\w)>")
_LETTERS = re.compile(r"[^\W\d_]{3,}")


def _head(message: str) -> str:
    return _FOLD.sub(" ", message.replace("\r\n", "\n").lstrip("\n").partition("\n\n")[0])


def address_path(message: str | None, *more: str | None) -> list[str]:
    """The places a message passed by, from its headers and from `more` (a mailbox, a folder): whole addresses, and as '/word' the
    words of their local parts, of lists, news groups and folders. Sorted, each once; hosts alone say nothing and are left out."""
    found: set[str] = set()
    routes = [(n.lower(), v) for n, v in _ROUTE.findall(_head(message))] if message else []
    for name, value in [*routes, *(("x-folder", m) for m in more if m)]:
        value = value.lower()
        addresses = [(m.group(1) or m.group(3), m.group(2) or m.group(4)) for m in _ADDRESS.finditer(value)]
        for local, host in addresses:
            found.add(f"{local}@{host}")
            found.update("/" + w for w in _LETTERS.findall(local))
        if not addresses and name in ("newsgroups", "x-folder"):
            found.update("/" + w for w in _LETTERS.findall(value))
    return sorted(found)
