"""What a page's own style sheets and inline styles say of ``display`` and ``visibility``.

The cascade of importance, layers, specificity and order over type, universal, class, id, attribute and structural selectors with all
combinators, and over nested rules. Rules for other media than screens, or that depend on the window, are left out; ``@supports`` holds
unless it is negated. A page is seen as it is loaded: nothing is hovered over or has the focus. A selector with a
pseudo-class that isn't known hides nothing and may show something.
"""

from __future__ import annotations

import re
from functools import lru_cache

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.DOTALL)
_MARK = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[{};]", re.DOTALL)
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*(?=;|\Z)", re.IGNORECASE)
_COMMA = re.compile(r",(?![^(]*\))(?![^\[]*\])")
_NAME = r"(?:[\w-]|\\.)+"
_SELECTOR = re.compile(
    rf"\s*(?P<join>[>+~])\s*|(?P<space>\s+)|(?P<all>\*)|(?P<kind>[#.])(?P<name>{_NAME})"
    rf"|\[\s*(?P<key>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]*)\s*(?P<case>[iIsS])?\s*)?\]"
    rf"|:(?P<pseudo>:?[\w-]+)(?:\((?P<inner>(?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\))?|(?P<tag>{_NAME})"
)
_NTH = re.compile(r"\s*(?:([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*\Z", re.IGNORECASE)
#: Never so while a page is loaded and untouched; elements that aren't in the tree are left out too.
NEVER = frozenset("hover focus active focus-within focus-visible target target-within visited fullscreen modal popover-open user-valid user-invalid autofill".split())
ELEMENTS = frozenset("before after first-line first-letter".split())
COUNTED = {"first-child": ("nth-child", "1"), "last-child": ("nth-last-child", "1"), "first-of-type": ("nth-of-type", "1"), "last-of-type": ("nth-last-of-type", "1")}


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def declared(source: str) -> dict[str, tuple[bool, str]]:
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in _DECLARATION.findall(_COMMENT.sub(" ", source)):
        if name.lower() not in found or bool(important) >= found[name.lower()][0]:
            found[name.lower()] = (bool(important), value.lower())
    return found


def on_screen(media: str) -> bool:
    return any(" ".join(q.lower().split()) in ("", "all", "screen", "only screen", "only all") for q in media.split(","))


def _holds(prelude: str) -> bool:
    name, _, rest = prelude[1:].replace("(", " (", 1).partition(" ")
    return name.lower() == "layer" or name.lower() == "media" and on_screen(rest) or name.lower() == "supports" and not rest.strip().lower().startswith("not")


def rules(source: str) -> list[tuple[str, str, bool]]:
    """Selectors, declarations and whether in a layer, of the rules that hold."""
    source = _COMMENT.sub(" ", source)
    out: list[tuple[str, str, bool]] = []
    open_: list[list] = []  # selectors or "", holds, in a layer, place of the rule, declarations
    start = 0
    for m in _MARK.finditer(source):
        mark, at = m[0], m.start()
        if mark == "{":
            prelude = source[start:at].strip()
            outer = open_[-1] if open_ else ["", True, False, 0, []]
            if prelude.startswith("@"):
                layer = outer[2] or prelude.lower().startswith("@layer")
                open_.append([outer[0], outer[1] and _holds(prelude), layer, len(out), []])
            else:
                if outer[0]:
                    prelude = ",".join(x.replace("&", f":is({outer[0]})") if "&" in x else f":is({outer[0]}) {x}" for x in _COMMA.split(prelude))
                open_.append([prelude, outer[1], outer[2], len(out), []])
            if open_[-1][0]:
                out.append(("", "", False))  # a rule stands before those nested in it
        elif mark in ";}":
            if open_ and open_[-1][0]:
                open_[-1][4].append(source[start:at])
            if mark == "}" and open_:
                selectors, holds, layer, place, body = open_.pop()
                if selectors and holds:
                    out[place] = (selectors, ";".join(body), layer)
        else:
            continue
        start = m.end()
    for selectors, holds, layer, place, body in open_:  # a sheet that is cut off
        if selectors and holds:
            out[place] = (selectors, ";".join([*body, source[start:]] if place == open_[-1][3] else body), layer)
    return [r for r in out if r[0]]


@lru_cache(maxsize=4096)
def selector(source: str) -> tuple[list, tuple[int, int, int], bool] | None:
    """Compounds from the left, each with its combinator to the one before; specificity; is it sure? None: matches nothing."""
    parts: list[tuple[str, list]] = [("", [])]
    weight, sure, at, source = [0, 0, 0], True, 0, source.strip()
    while at < len(source):
        m = _SELECTOR.match(source, at)
        if m is None:
            return None
        at = m.end()
        if m["join"] or m["space"]:
            parts.append((m["join"] or " ", []))
            continue
        tests = parts[-1][1]
        if m["kind"]:
            weight[0 if m["kind"] == "#" else 1] += 1
            tests.append((m["kind"], _plain(m["name"])))
        elif m["key"]:
            weight[1] += 1
            value = (m["value"] or "").strip("\"'")
            tests.append(("[", (_plain(m["key"]).lower(), m["op"], value, (m["case"] or "").lower() == "i")))
        elif m["tag"]:
            weight[2] += 1
            tests.append(("tag", _plain(m["tag"]).lower()))
        elif m["pseudo"]:
            name, inner = m["pseudo"].lower(), m["inner"]
            if name.startswith(":") or name in ELEMENTS or name in NEVER:
                return None
            if name in ("is", "where", "not", "matches", "-webkit-any", "-moz-any") and inner is not None:
                inside = [x for x in map(selector, _COMMA.split(inner)) if x]
                if any(not x[2] for x in inside):
                    sure = False
                    continue
                if name != "where" and inside:
                    weight = [a + b for a, b in zip(weight, max(x[1] for x in inside), strict=True)]
                tests.append(("not" if name == "not" else "is", [x[0] for x in inside]))
                continue
            weight[1] += 1
            name, inner = COUNTED.get(name, (name, inner))
            if name.startswith("nth-") and (nth := _NTH.match({"odd": "2n+1", "even": "2n"}.get((inner or "").strip().lower(), inner or ""))):
                step = 0 if nth[4] else int(nth[1] + "1" if nth[1] in ("", "+", "-") else nth[1])
                tests.append((name, (step, int(nth[4] or (nth[2] or "") + (nth[3] or "0")))))
            elif name in ("root", "checked", "disabled", "enabled", "link", "any-link", "empty", "only-child"):
                tests.append((name, None))
            else:
                sure = False
    return parts, tuple(weight), sure


class Sheet:
    """The styles of the elements of one page."""

    def __init__(self, root) -> None:
        self.by: dict[tuple, list] = {}
        self.at: dict[int, tuple] = {}  # of an element: its parent, and its fellow elements
        self.place: dict[int, int] = {}
        sheets, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == "style":
                if on_screen(node.attributes.get("media", "")) and node.attributes.get("type", "").lower() in ("", "text/css"):
                    sheets.append("".join(map(str, node.children)))
            elif node.tag != "template":
                stack += [c for c in reversed(node.children) if not isinstance(c, str)]
        order = 0
        for source in sheets:
            lower = source.lower()
            if "display" not in lower and "visibility" not in lower:
                continue
            for selectors, body, layer in rules(source):
                if says := declared(body):
                    for text in _COMMA.split(selectors):
                        if (own := selector(text)) is not None:
                            order += 1
                            self._add(own, says, not layer, order)
        if self.by:
            stack = [root]
            while stack:
                node = stack.pop()
                inner = [c for c in node.children if not isinstance(c, str)]
                for i, c in enumerate(inner):
                    self.at[id(c)], self.place[id(c)] = (node, inner), i
                stack += inner

    def _add(self, own: tuple, says: dict, unlayered: bool, order: int) -> None:
        parts, weight, sure = own
        keys = {kind: value for kind, value in parts[-1][1] if kind in ("#", ".", "tag")}
        kind = next((k for k in ("#", ".", "tag") if k in keys), "")
        if not sure:
            says = {k: v for k, v in says.items() if v[1] not in ("none", "hidden", "collapse")}
        self.by.setdefault((kind, keys.get(kind, "")), []).append((parts, says, unlayered, (0, *weight), order))

    def style(self, node) -> dict[str, str]:
        """display and visibility where something is said of them."""
        a, best = node.attributes, {}
        if self.by:
            keys = [("", ""), ("tag", node.tag)]
            if a:
                keys += [("#", a.get("id", "")), *((".", c) for c in set(a.get("class", "").split()))]
            for key in keys:
                for parts, says, unlayered, weight, order in self.by.get(key, ()):
                    if self._matches(parts, len(parts) - 1, node) is True:
                        for name, (important, value) in says.items():
                            best[name] = max(best.get(name, ((),)), ((important, unlayered, weight, order), value))
        if "style" in a:
            for name, (important, value) in declared(a["style"]).items():
                best[name] = max(best.get(name, ((),)), ((important, True, (1, 0, 0, 0), 0), value))
        out = {k: v[1] for k, v in best.items()}
        if node.foreign:
            out = {k: a[k].strip().lower() for k in ("display", "visibility") if k in a} | out
        if out.get("display") in ("revert", "revert-layer"):
            del out["display"]
        if (seen := out.get("visibility")) in ("inherit", "unset", "revert", "revert-layer"):
            del out["visibility"]
        elif seen == "initial":
            out["visibility"] = "visible"
        return out

    def _matches(self, parts: list, k: int, node) -> bool | None:
        """None: nor would it from an element further up."""
        join, tests = parts[k]
        if not all(self._is(node, kind, value) for kind, value in tests):
            return False
        if k == 0:
            return True
        parent, fellows = self.at.get(id(node), (None, ()))
        if join in "+~":
            near = fellows[: self.place[id(node)]] if parent else []
            return any(self._matches(parts, k - 1, x) is True for x in (near[-1:] if join == "+" else near))
        while parent is not None:
            if (found := self._matches(parts, k - 1, parent)) is not False or join == ">":
                return found
            parent = self.at.get(id(parent), (None,))[0]
        return None if join == " " else False

    def _is(self, node, kind: str, value) -> bool:
        a = node.attributes
        if kind == "tag":
            return node.tag == value
        if kind == ".":
            return value in a.get("class", "").split()
        if kind == "#":
            return a.get("id") == value
        if kind == "[":
            key, op, wanted, fold = value
            if key not in a or op is None:
                return key in a
            own = a[key].lower() if fold else a[key]
            wanted = wanted.lower() if fold else wanted
            if op == "=":
                return own == wanted
            if op == "~=":
                return wanted in own.split()
            if op == "|=":
                return own == wanted or own.startswith(wanted + "-")
            return bool(wanted) and (own.startswith(wanted) if op == "^=" else own.endswith(wanted) if op == "$=" else wanted in own)
        if kind in ("is", "not"):
            return any(self._matches(x, len(x) - 1, node) is True for x in value) is (kind == "is")
        if kind == "checked":
            return "checked" in a or "selected" in a
        if kind in ("disabled", "enabled"):
            return ("disabled" in a) is (kind == "disabled")
        if kind in ("link", "any-link"):
            return "href" in a
        if kind == "empty":
            return not node.children
        parent, fellows = self.at.get(id(node), (None, [node]))
        if kind == "root":
            return parent is None
        if kind == "only-child":
            return len(fellows) == 1
        step, first = value
        if kind.endswith("of-type"):
            fellows = [x for x in fellows if x.tag == node.tag]
            at = next(i for i, x in enumerate(fellows) if x is node)
        else:
            at = self.place.get(id(node), 0)
        n = (len(fellows) - at if "last" in kind else at + 1) - first
        return n == 0 if step == 0 else n % step == 0 and n // step >= 0
