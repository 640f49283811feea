"""Reading what a model says: values out of free text, labels, property names."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterable

#: The classes of a paragraph, and words for nothing.
LABELS = ("table", "figure", "synthesis condition", "property", "else")
NOTHING = {"", "none", "null", "n/a", "na"}


def _blocks(text: str) -> Iterable[str]:
    """Balanced bracket blocks in order of their start; brackets in quotes do not count."""
    pairs = {"{": "}", "[": "]"}
    for start, opener in enumerate(text):
        if opener not in pairs:
            continue
        stack, quote, skip = [], "", False
        for at in range(start, len(text)):
            c = text[at]
            if skip:
                skip = False
            elif c == "\\":
                skip = bool(quote)
            elif quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and stack and not (c == "'" and at and text[at - 1].isalnum()):
                quote = c
            elif c in pairs:
                stack.append(pairs[c])
            elif c in "}]":
                if not stack or stack.pop() != c:
                    break
                if not stack:
                    yield text[start : at + 1]
                    break


def parse_reply(text: str | None) -> object:
    """The value in a reply: a Python or JSON literal, in a code fence, after a label, or the first balanced block of prose."""
    body = re.sub(r"^\s*(?:output|answer|result)\s*:\s*", "", (text or "").strip(), flags=re.I)
    fence = re.search(r"```[a-zA-Z]*\s*\n?(.*?)```", body, re.S)
    body = re.sub(r"^\s*json\s*\n", "", (fence.group(1) if fence else body).strip(), flags=re.I)
    for candidate in (body, *_blocks(body)):
        for read in (ast.literal_eval, json.loads):
            try:
                return read(candidate)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
    raise ValueError("no value in the reply")


def labels_of(reply: object) -> list[str]:
    """Known labels of a reply, once each; ``else`` where there is none."""
    text = " , ".join(map(str, reply)) if isinstance(reply, list | tuple) else str(reply or "")
    found = []
    for part in re.split(r"[,\n]", text.lower()):
        part = re.sub(r"[^a-z ]+", " ", part.replace("_", " ")).strip()
        hit = next((x for x in LABELS if part == x or (x != "else" and part.startswith(x.split()[0]))), None)
        if hit and hit not in found:
            found.append(hit)
    return found or ["else"]


def names_of(reply: object) -> list[str]:
    """Property names of a possibly nested reply: lower case, underscores, nothing-words out, order kept."""
    out: list[str] = []
    for item in reply if isinstance(reply, list | tuple | set) else [reply]:
        if isinstance(item, list | tuple | set):
            names = names_of(item)
        else:
            names = [re.sub(r"[\s-]+", "_", str(item or "").strip().lower())]
        out += [n for n in names if n not in NOTHING and n not in out]
    return out
