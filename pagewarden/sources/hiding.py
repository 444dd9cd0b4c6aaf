"""Which elements of one page are hidden: style sheets, inline styles and what children inherit."""

from __future__ import annotations

import re

#: Properties that hide an element or its subtree.
PROPERTIES = {"display", "visibility", "opacity", "width", "height"}
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMPOUND = re.compile(r"(?:\*|[a-z][a-z0-9-]*)?(?:[.#][\w-]+|\[[\w-]+\])*", re.I)
_PART = re.compile(r"[.#]?[\w*-]+|\[[\w-]+\]")
_ZERO = re.compile(r"0(?![.\d])")


def declarations(text: str) -> list[tuple[str, str, bool]]:
    """Property, value and importance of the declarations that can hide."""
    out = []
    for item in text.split(";"):
        name, colon, value = item.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name in PROPERTIES:
            bare = value.removesuffix("!important").strip()
            out.append((name, bare, bare != value))
    return out


class Sheet:
    """The rules of a page's ``<style>`` elements that can hide.

    Selectors are compounds of a tag, ids, classes and ``[attribute]``, joined by descendant and child combinators; others, and rules within at-rules,
    are left out.  Rules are found by the last id, class or tag of their selector, so an element is held against few of them.
    """

    def __init__(self, text: str):
        self.rules: dict[str, list[tuple]] = {}
        place = 0
        for selectors, body in _RULE.findall(_AT_RULE.sub(" ", _COMMENT.sub(" ", text))):
            found = declarations(body)
            for selector in selectors.split(",") if found else ():
                parts = re.sub(r"\s*>\s*", " >", selector.strip()).split()
                steps = [(p.startswith(">"), _PART.findall(p.removeprefix(">"))) for p in parts if _COMPOUND.fullmatch(p.removeprefix(">"))]
                if not steps or len(steps) < len(parts):
                    continue
                names = [n for _, s in steps for n in s if n != "*"]
                weight = (sum(n[0] == "#" for n in names), sum(n[0] in ".[" for n in names), sum(n[0] not in "#.[" for n in names))
                last = steps[-1][1]
                key = next((n for n in last if n[0] == "#"), next((n for n in last if n[0] == "."), next((n.lower() for n in last if n[0] not in "[*"), "*")))
                place += 1
                self.rules.setdefault(key, []).append((weight, place, steps, found))

    def matching(self, page: list, k: int) -> list[tuple]:
        """(weight, place, declarations) of the rules that select an element of ``page`` (parent, tag, names)."""
        _, tag, names = page[k]
        keys = ["*", tag, *[n for n in names if n[0] in "#."]]
        return [(w, place, found) for key in keys for w, place, steps, found in self.rules.get(key, ()) if _selects(page, k, steps)]


def _selects(page: list, k: int, steps: list) -> bool:
    """Whether the steps of a selector lead to an element; a descendant step tries every ancestor."""
    child, wanted = steps[-1]
    parent, tag, names = page[k]
    if not all(n == "*" or n in names or n.lower() == tag for n in wanted):
        return False
    if len(steps) == 1:
        return True
    while parent is not None:
        if _selects(page, parent, steps[:-1]):
            return True
        if child:
            return False
        parent = page[parent][0]
    return False


def shown(page: list, styles: list[str | None], types: list[str | None], sheet_text: str) -> list[bool]:
    """For each element of ``page`` (parent, tag, names: ids, classes and attributes as selectors write them), whether it can be seen.

    ``display: none`` and the attribute hidden hide the whole subtree, ``visibility`` is inherited until a child sets it anew, and
    no opacity or no size hides the element alone.
    """
    sheet = Sheet(sheet_text) if sheet_text else None
    gone, unseen, out = [], [], []
    for k, (parent, _, names) in enumerate(page):
        found = [((False, False, w, place), d) for w, place, ds in (sheet.matching(page, k) if sheet else ()) for d in ds]
        found += [((False, True, (0, 0, 0), i), d) for i, d in enumerate(declarations(styles[k] or ""))]
        own = {"display": "none"} if "[hidden]" in names else {}
        for _, (name, value, _) in sorted((((d[2], *order[1:]), d) for order, d in found), key=lambda x: x[0]):
            own[name] = value
        gone.append(own.get("display") == "none" or (parent is not None and gone[parent]))
        seen = own.get("visibility")
        seen = None if seen == "inherit" else seen
        unseen.append(seen in ("hidden", "collapse") if seen else parent is not None and unseen[parent])
        clear = own.get("opacity", "")
        flat = any(_ZERO.match(own.get(side, "")) for side in ("width", "height"))
        out.append(not (gone[k] or unseen[k] or flat or re.fullmatch(r"0*\.?0+%?|0+\.", clear) or types[k] == "hidden"))
    return out
