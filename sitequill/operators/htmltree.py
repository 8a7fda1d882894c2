"""Lenient HTML tree on the standard library parser, used inside Spark tasks.

Tree rules: an end tag closes the nearest open element of that name (stray end
tags are ignored); void elements never take children; ``p`` is not closed
implicitly. Text inside ``script``/``style``/``template`` and comments are kept
as nodes but excluded from ``text()``.

Selectors are structured, not parsed: a selector is a list of compound steps
joined by the descendant combinator; a step is a tuple of conditions
``("tag", name)``, ``("class", name)``, ``("attr", name, value)``,
``("attr*", name, substring)`` or ``("has", name)``.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset(("script", "style", "template"))


class Comment(str):
    """A comment node; never part of ``text()``."""


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: "Node | None" = None):
        self.tag = tag
        self.attrs = attrs or {}
        self.children: list = []
        self.parent = parent

    # -- attributes ------------------------------------------------------
    def get(self, name: str, default=None):
        return self.attrs.get(name, default)

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    # -- traversal -------------------------------------------------------
    def elements(self):
        """Element children."""
        return [c for c in self.children if isinstance(c, Node)]

    def descendants(self):
        """Descendant elements in document order (iterative, no recursion limit)."""
        stack = list(reversed(self.elements()))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.elements()))

    def find_all(self, pred, recursive: bool = True):
        it = self.descendants() if recursive else self.elements()
        return [n for n in it if pred(n)]

    def find(self, pred, recursive: bool = True):
        it = self.descendants() if recursive else self.elements()
        for n in it:
            if pred(n):
                return n
        return None

    def strings(self):
        """Visible text strings in document order."""
        stack = [self]
        out = []
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                if n.tag in HIDDEN_TEXT:
                    continue
                stack.extend(reversed(n.children))
            elif not isinstance(n, Comment):
                out.append(n)
        return out

    def text(self, sep: str = "", strip: bool = False) -> str:
        parts = self.strings()
        if strip:
            parts = [p.strip() for p in parts]
            parts = [p for p in parts if p]
        return sep.join(parts)

    def decompose(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace_with_text(self, s: str) -> None:
        p = self.parent
        if p is None:
            return
        p.children = [s if c is self else c for c in p.children]
        self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        kids = self.stack[-1].children
        if kids and type(kids[-1]) is str:
            kids[-1] += data
        else:
            kids.append(data)

    def handle_comment(self, data):
        self.stack[-1].children.append(Comment(data))


def parse(html: str | None) -> Node:
    """Tree of a page. The standard parser gives up on a few malformed
    declarations with an AssertionError; what it has not read by then is kept
    as text, so no page loses content."""
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except AssertionError:
        b.handle_data(b.rawdata)
    return b.root


# -- selectors ---------------------------------------------------------------

def _cond(node: Node, c: tuple) -> bool:
    kind = c[0]
    if kind == "tag":
        return node.tag == c[1]
    if kind == "class":
        return c[1] in node.classes
    if kind == "attr":
        return node.attrs.get(c[1]) == c[2]
    if kind == "attr*":
        v = node.attrs.get(c[1])
        return v is not None and c[2] in v
    if kind == "has":
        return c[1] in node.attrs
    if kind == "child":  # where the element stands is checked by select
        return True
    v = node.attrs.get(c[1])
    if kind == "attr^":
        return v is not None and c[2] != "" and v.startswith(c[2])
    if kind == "attr$":
        return v is not None and c[2] != "" and v.endswith(c[2])
    if kind == "attr~":
        return v is not None and c[2] in v.split()
    raise ValueError(kind)


def matches(node: Node, step: tuple) -> bool:
    return all(_cond(node, c) for c in step)


def select(root: Node, selector: list) -> list[Node]:
    """Elements under ``root`` matching a selector of steps; a step that begins
    with ("child",) stands directly below the one before it."""
    *ancestors, last = selector
    if not ancestors:
        return [n for n in root.descendants() if matches(n, last)]
    if any(step[:1] == (("child",),) for step in selector):
        return [n for n in root.descendants() if matches(n, last) and _held(n, selector)]
    out = []
    for n in root.descendants():
        if not matches(n, last):
            continue
        need = len(ancestors) - 1
        p = n.parent
        while need >= 0 and p is not None:
            if matches(p, ancestors[need]):
                need -= 1
            p = p.parent
        if need < 0:
            out.append(n)
    return out


def _held(node: Node, selector: list) -> bool:
    """Whether the element's ancestors match all but the last step. For every
    step the elements that may stand for it are followed upwards together."""
    here = [node]
    for i in range(len(selector) - 1, 0, -1):
        direct = selector[i][:1] == (("child",),)
        above: dict[int, Node] = {}
        for n in here:
            p = n.parent
            while p is not None:
                if id(p) not in above and matches(p, selector[i - 1]):
                    above[id(p)] = p
                p = None if direct else p.parent
        here = list(above.values())
    return bool(here)


def select_any(root: Node, selectors: list) -> list[Node]:
    """Union of several selectors, in document order (a CSS selector group)."""
    if all(len(s) == 1 for s in selectors):
        hit = compile_steps([s[0] for s in selectors])
        return [n for n in root.descendants() if hit(n)]
    hits = set()
    for s in selectors:
        hits.update(id(n) for n in select(root, s))
    return [n for n in root.descendants() if id(n) in hits]


def compile_steps(steps: list):
    """Predicate ``node -> bool`` true when any step matches; single-condition
    tag/class/attr steps become set lookups."""
    tags, classes, attrs, other = set(), set(), set(), []
    for st in steps:
        if len(st) == 1 and st[0][0] == "tag":
            tags.add(st[0][1])
        elif len(st) == 1 and st[0][0] == "class":
            classes.add(st[0][1])
        elif len(st) == 1 and st[0][0] == "attr":
            attrs.add((st[0][1], st[0][2]))
        else:
            other.append(st)
    attr_names = {a for a, _ in attrs}

    def pred(n: Node) -> bool:
        if n.tag in tags:
            return True
        if classes:
            c = n.attrs.get("class")
            if c and not classes.isdisjoint(c.split()):
                return True
        if attr_names:
            for a in attr_names:
                v = n.attrs.get(a)
                if v is not None and (a, v) in attrs:
                    return True
        return any(matches(n, st) for st in other) if other else False

    return pred


def remove_matching(root: Node, steps: list) -> None:
    """Decompose every element matching any of ``steps`` (one traversal;
    the subtree of a removed element is not visited)."""
    doomed = []
    hit = compile_steps(steps)
    stack = list(reversed(root.elements()))
    while stack:
        n = stack.pop()
        if hit(n):
            doomed.append(n)
            continue
        stack.extend(reversed(n.elements()))
    for n in doomed:
        n.decompose()


def select_one(root: Node, selector: list) -> Node | None:
    if len(selector) == 1:
        for n in root.descendants():
            if matches(n, selector[0]):
                return n
        return None
    r = select(root, selector)
    return r[0] if r else None


def tag(name: str) -> tuple:
    return (("tag", name),)


def cls(name: str) -> tuple:
    return (("class", name),)


def attr(name: str, value: str, tag_name: str | None = None) -> tuple:
    c = (("attr", name, value),)
    return ((("tag", tag_name),) + c) if tag_name else c
