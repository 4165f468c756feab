"""Prompt templates: Markdown with two placeholders, split into a system and a human part by headings."""

from __future__ import annotations

import json
import re

MENU, CONTENT = "{taxonomy_menu}", "{document_content}"
SYSTEM, HUMAN = "# System Prompt", "# Human Prompt"
DEFAULT = f"""# System Prompt
You file documents.  Answer with one JSON object of domain, category, doctype, vendor, date (YYYYMMDD) and subject, all text.
{MENU}

# Human Prompt
{CONTENT}"""


class TemplateError(ValueError):
    """A template that cannot be read or used."""


def _frontmatter(text: str) -> dict:
    try:
        import yaml
    except ImportError:  # JSON is YAML, and plain lines of ``key: value`` are read without a library
        try:
            return json.loads(text)
        except ValueError:
            pairs = [line.partition(":") for line in text.strip().splitlines() if line.strip()]
            if not all(sep for _, sep, _ in pairs):
                raise TemplateError("invalid YAML frontmatter") from None
            return {k.strip(): v.strip() for k, _, v in pairs}
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise TemplateError(f"invalid YAML frontmatter: {e}") from e


def parted(raw: str) -> tuple[dict, str]:
    """(frontmatter, body) of a template; frontmatter stands between two lines of dashes at its beginning."""
    found = re.match(r"---[^\S\n]*\n(.*?)^---[^\S\n]*$", raw, re.S | re.M)
    return (_frontmatter(found[1]), raw[found.end() :].strip()) if found else ({}, raw)


def load(path: str) -> tuple[dict, str]:
    """(frontmatter, body) of a template file; what hinders that is a TemplateError that says so."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = f.read()
    except FileNotFoundError as e:
        raise TemplateError(f"template not found: {path}") from e
    except PermissionError as e:
        raise TemplateError(f"template may not be read: {path}") from e
    except UnicodeDecodeError as e:
        raise TemplateError(f"template is not UTF-8: {path}: {e}") from e
    except OSError as e:
        raise TemplateError(f"template cannot be read: {path}: {e}") from e
    matter, body = parted(raw)
    split(body)
    return matter, body


def split(template: str) -> tuple[str, str]:
    """(system, human).  Both placeholders must occur, and both headings or neither: then all of it is human."""
    body = parted(template)[1]
    missing = [p for p in (MENU, CONTENT) if p not in body]
    if missing:
        raise TemplateError(f"template lacks {', '.join(missing)}")
    has = (SYSTEM in body, HUMAN in body)
    if has[0] != has[1]:
        raise TemplateError("template has one of the two headings only")
    if not has[0]:
        return "", body.strip()
    system, human = body.split(HUMAN, 1)
    return system.split(SYSTEM, 1)[1].strip(), human.strip()


def render(part: str, menu: str, content: str) -> str:
    """The menu first, so that a document's text is never searched for its place."""
    return part.replace(MENU, menu).replace(CONTENT, content)
