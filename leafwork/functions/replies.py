"""Prompts for a model and what comes back: protected formulas, prompts, and the ladder of reply formats.

Plain functions over one reply; operators.translate runs them where the replies are, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

# What is protected, in this order; and the texts of prompts.
PROTECTED = [
    re.compile(r"\\[A-Za-z]+(?:\s*\{[^{}]{0,120}\}){0,2}"),
    re.compile(r"(?<![A-Za-z])(?:[A-Za-z0-9_().{}\[\]]+)(?:\s*[=+*/^_<>]\s*[A-Za-z0-9_().{}\[\]]+)+(?![A-Za-z])"),
    re.compile("[≤≥≈≠∑∫√±×÷∞∂∇∗−′″]+"),
    re.compile(r"(?<!\w)[=+*/^_<>](?!\w)|(?<=\s)[=+*/^_<>](?=\s)"),
]
TOKEN = "MATHSEG{}TOKEN"
INDEX = re.compile(r"(?m)^\s*\[(\d+)\]\s*")
STRICT = " Translate every sentence; leave no English sentence, add no item, and write nothing about the task."


def protect(text: str) -> tuple[str, list[str]]:
    """The text with formulas as numbered tokens, and the formulas."""
    found: list[str] = []

    def token(m: re.Match) -> str:
        found.append(m[0])
        return TOKEN.format(len(found) - 1)

    for pattern in PROTECTED:
        text = pattern.sub(token, text)
    return text, found


def restore(text: str, found: list[str]) -> str:
    """Formulas put back literally, the last first: a later token may hold an earlier one."""
    for k in range(len(found) - 1, -1, -1):
        text = re.sub(TOKEN.format(k), lambda _, x=found[k]: x, text, flags=re.I)
    return text


def messages(texts: list[str], style: str = "", glossary: str = "", strict: bool = False) -> list[dict[str, str]]:
    """A chat prompt for one text, or for several with an index each."""
    many = len(texts) > 1
    system = "Translate English academic text to Simplified Chinese. Keep formulas, urls, citations, code and placeholders such as MATHSEG12TOKEN as they are. Keep list numbers and line breaks. Add nothing. "
    system += f"There are {len(texts)} segments; treat each by itself and return exactly {len(texts)} lines, each as: [index] translation." if many else "Return the translation only."
    body = "\n".join(f"[{k}] {t}" for k, t in enumerate(texts, 1)) if many else "".join(texts)
    user = [*([f"Style={style}"] if style else []), *([f"Terms={glossary}"] if glossary else []), f"{'Segments' if many else 'Text'}:\n{body}"]
    return [{"role": "system", "content": system + STRICT * strict}, {"role": "user", "content": "\n".join(user)}]


def unfenced(raw: str) -> str:
    text = raw.strip()
    return re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text)).strip() if text.startswith("```") else text


def json_candidates(raw: str) -> list[str]:
    text = unfenced(raw)
    found = [m[0] for p in (r"\{[\s\S]*\}", r"\[[\s\S]*\]") if (m := re.search(p, text))]
    return [x for x in dict.fromkeys([text, *found]) if x]


def _from_json(raw: str, n: int) -> list[str] | None:
    for candidate in json_candidates(raw):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        value = value.get("translations") if isinstance(value, dict) else value
        return [str(x).strip() for x in value] if isinstance(value, list) else None
    return None


def marked(raw: str, n: int) -> list[str] | None:
    """Texts behind [1]..[n]: None if an index comes twice, is missing, or has no text; others are skipped."""
    text, out = unfenced(raw), {}
    at = list(INDEX.finditer(text))
    for m, end in zip(at, [*(m.start() for m in at[1:]), len(text)]):
        k = int(m[1])
        if 1 <= k <= n:
            value = text[m.end() : end].strip()
            if k in out or not value:
                return None
            out[k] = value
    return [out[k] for k in range(1, n + 1)] if len(out) == n else None


def _pieces(pattern: str) -> Callable[[str, int], list[str] | None]:
    def read(raw: str, n: int) -> list[str] | None:
        parts = [x.strip() for x in re.split(pattern, unfenced(raw)) if x.strip()]
        return parts if len(parts) == n else None

    return read


#: Formats in the order they are tried.
LADDER = [_from_json, marked, _pieces(r"\n\s*\n+"), _pieces(r"[\r\n]+"), lambda raw, n: [unfenced(raw)] if n == 1 and unfenced(raw) else None]


class ReplyError(RuntimeError):
    pass


def parse(raw: str, sources: list[str]) -> list[str]:
    """A translation for each source; a blank one is the source itself. ReplyError if no format fits."""
    for read in LADDER:
        if (found := read(raw, len(sources))) is not None:
            if len(found) != len(sources):
                raise ReplyError(f"batch size mismatch: expected {len(sources)}, got {len(found)}")
            return [x.strip() or s for x, s in zip(found, sources)]
    raise ReplyError("batch response parse failed")
