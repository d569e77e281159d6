"""A small sandboxed template language for chats: syntax tree, constant folding, closures, and the way back (op 13).

    {{ expr }}  {# comment #}  {% for m in messages %} .. {% endfor %}
    {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% generation %} .. {% endgeneration %}        text under the loss mask

Expressions: strings, whole numbers, ``true``, ``false``, ``m.role``, ``m.text``, ``loop.first``, ``loop.last``,
``loop.index0``, ``loop.previous_role``, ``loop.next_role``, names of constants given to the compiler, ``== != in``,
``and or not``, ``+``, parentheses, and the filters ``guard trim upper lower``. Nothing else can be named, so a
template reaches neither Python objects nor files; the only loop is the one over the messages, at the top, so it
ends and can be fed turn by turn.

``guard`` makes control strings inside a value harmless and can be undone: a control string gets one more escape
sign after its first character than it had.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

ESCAPE = "\\"

#: every turn opens with <s> and a mark of its kind; only the assistant's text is under the loss mask
CHAT = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | guard }} [/INST]"
    "{% elif m.role == 'assistant' %}<s>[OUT] {% generation %}{{ m.text | guard }}{% endgeneration %}</s>"
    "{% else %}<s>[ROLE] {{ m.role | guard }} [TEXT] {{ m.text | guard }}</s>"
    "{% endif %}{% endfor %}"
)
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]")

LOOP = ("first", "last", "index0", "previous_role", "next_role")


class TemplateError(ValueError):
    """A template that doesn't parse, names what it may not, or can't be read back."""


# -- guard ---------------------------------------------------------------------------------------


class Guard:
    """Escapes control strings. Each must hold its first character once and no escape sign, so that no two overlap."""

    def __init__(self, controls: tuple[str, ...]) -> None:
        for c in controls:
            if len(c) < 2 or c[0] in c[1:] or ESCAPE in c:
                raise TemplateError(f"not a control string: {c!r}")
            if any(c[0] in other[1:] for other in controls):
                raise TemplateError(f"{c!r} may begin inside another control string")
        self.controls = controls
        heads: dict[str, list[str]] = {}
        for c in controls:
            heads.setdefault(c[0], []).append(re.escape(c[1:]))
        e = re.escape(ESCAPE)
        body = "|".join(f"{re.escape(h)}{e}*(?:{'|'.join(rest)})" for h, rest in heads.items())
        self._found = re.compile(body)
        self._heads = tuple(heads)

    def hide(self, text: str) -> str:
        if not any(h in text for h in self._heads):
            return text
        return self._found.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    def show(self, text: str) -> str:
        if ESCAPE not in text:
            return text
        return self._found.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == ESCAPE else m[0], text)


# -- syntax tree ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Get:
    of: str  # "m" or "loop"
    name: str


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loss:
    body: tuple


@dataclass(frozen=True)
class For:
    body: tuple


_PARTS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()\[\]]))")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:]!r}")
        at = m.end()
        quoted = m[1] if m[1] is not None else m[2]
        if quoted is not None:
            out.append(("value", re.sub(r"\\(.)", lambda e: _ESCAPED.get(e[1], e[1]), quoted, flags=re.S)))
        elif m[3]:
            out.append(("value", int(m[3])))
        else:
            out.append(("name", m[4]) if m[4] else ("sign", m[5]))
    return out


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str, constants: dict[str, object], variable: str | None) -> None:
        self.tokens, self.at = _tokens(text), 0
        self.constants, self.variable = constants, variable

    def next_is(self, *wanted) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return True
        return False

    def take(self, kind: str):
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.next_is(("name", "or")):
            out = Call("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.next_is(("name", "and")):
            out = Call("and", (out, self.negated()))
        return out

    def negated(self):
        if self.next_is(("name", "not")):
            return Call("not", (self.negated(),))
        out = self.joined()
        for sign, op in ((("sign", "=="), "=="), (("sign", "!="), "!="), (("name", "in"), "in")):
            if self.next_is(sign):
                return Call(op, (out, self.joined()))
        return out

    def joined(self):
        out = self.filtered()
        while self.next_is(("sign", "+")):
            out = Call("+", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.atom()
        while self.next_is(("sign", "|")):
            name = self.take("name")
            if name not in ("guard", "trim", "upper", "lower"):
                raise TemplateError(f"no filter {name}")
            out = Call(name, (out,))
        return out

    def atom(self):
        if self.next_is(("sign", "(")):
            out = self.either()
            if not self.next_is(("sign", ")")):
                raise TemplateError(") expected")
            return out
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)
        self.at += 1
        if kind == "value":
            return Const(value)
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return Const(value == "true")
        if self.variable and value in (self.variable, "loop"):
            if self.next_is(("sign", "[")):
                name = self.take("value")
                if not self.next_is(("sign", "]")):
                    raise TemplateError("] expected")
            elif self.next_is(("sign", ".")):
                name = self.take("name")
            else:
                raise TemplateError(f"{value} is no value")
            of = "loop" if value == "loop" else "m"
            if name not in (LOOP if of == "loop" else ("role", "text")):
                raise TemplateError(f"no {value}.{name}")
            return Get(of, name)
        if value in self.constants:
            return Const(self.constants[value])
        raise TemplateError(f"unknown name {value}")


def parse(source: str, constants: dict[str, object] | None = None) -> tuple:
    """The tree of a template. White space beside ``{%-`` and ``-%}`` goes."""
    pieces = _PARTS.split(source)
    for i in range(1, len(pieces), 2):
        if pieces[i][2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    at, variable, known = 0, None, constants or {}

    def expression(text: str):
        return _Expression(text, known, variable).whole()

    def block(ends: tuple[str, ...], top: bool = False, loss: bool = False) -> tuple[tuple, str]:
        nonlocal at, variable
        nodes = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if at % 2:  # text between tags
                if re.search(r"\{\{|\{%|%\}|\}\}", piece):
                    raise TemplateError(f"open tag in {piece!r}")
                nodes.append(Emit(Const(piece)))
                continue
            inner = piece[2:-2].strip("-").strip()
            if piece[:2] == "{{":
                nodes.append(Emit(expression(inner)))
            elif piece[:2] == "{%":
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return tuple(nodes), inner
                if word == "if":
                    nodes.append(branch(rest, loss))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*) in messages", rest.strip())
                    if not (m and top) or any(isinstance(n, For) for n in nodes) or m[1] in ("loop", *known):
                        raise TemplateError("one loop over messages, at the top")
                    variable = m[1]
                    nodes.append(For(block(("endfor",))[0]))
                    variable = None
                elif word == "generation" and not loss:
                    nodes.append(Loss(block(("endgeneration",), loss=True)[0]))
                else:
                    raise TemplateError(f"unexpected tag {inner!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return tuple(nodes), ""

    def branch(test: str, loss: bool) -> If:
        condition = expression(test)
        then, end = block(("elif", "else", "endif"), loss=loss)
        if end.startswith("elif"):
            return If(condition, then, (branch(end[4:], loss),))
        other = block(("endif",), loss=loss)[0] if end == "else" else ()
        return If(condition, then, other)

    return block((), top=True)[0]


# -- folding and closures ------------------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else str(value)


@dataclass
class Sink:
    """What a template writes: text in parts, and spans of code points under the loss mask."""

    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def write(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.size += len(text)


class Template:
    """A compiled template: ``head``, ``turn`` and ``tail`` write into a sink; ``read`` takes turns out of what was written."""

    def __init__(self, source: str = CHAT, controls: tuple[str, ...] = CONTROLS, constants: dict[str, object] | None = None) -> None:
        self.guard = Guard(controls)
        self._calls: dict[str, Callable] = {
            "guard": lambda v: self.guard.hide(_text(v)),
            "trim": lambda v: _text(v).strip(),
            "upper": lambda v: _text(v).upper(),
            "lower": lambda v: _text(v).lower(),
            "not": lambda v: not v,
            "==": lambda a, b: a == b,
            "!=": lambda a, b: a != b,
            "in": lambda a, b: _text(a) in _text(b),
            "+": lambda a, b: _text(a) + _text(b),
        }
        tree = self.folded(parse(source, constants))
        loops = [i for i, n in enumerate(tree) if isinstance(n, For)]
        if not loops:
            raise TemplateError("no loop over messages")
        at = loops[0]
        self.body = tree[at].body
        outside = (*tree[:at], *tree[at + 1 :])
        self.head, self.turn, self.tail = self._block(tree[:at]), self._block(self.body), self._block(tree[at + 1 :])
        #: whether a turn's place decides what is written; if not, turns can be written apart
        self.needs_place = bool(outside) or "Get(of='loop'" in repr(self.body)

    def folded(self, nodes: tuple) -> tuple:
        """Constant expressions evaluated, decided branches resolved, neighbouring texts joined."""
        out: list = []

        def add(node) -> None:
            if isinstance(node, Emit) and isinstance(node.value, Const):
                text = _text(node.value.value)
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(out[-1].value.value + text))
                elif text:
                    out.append(Emit(Const(text)))
            else:
                out.append(node)

        for node in nodes:
            if isinstance(node, Emit):
                add(Emit(self._fold(node.value)))
            elif isinstance(node, If):
                test = self._fold(node.test)
                if isinstance(test, Const):
                    for n in self.folded(node.then if test.value else node.other):
                        add(n)
                else:
                    add(If(test, self.folded(node.then), self.folded(node.other)))
            elif isinstance(node, Loss):
                add(Loss(self.folded(node.body)))
            else:
                add(For(self.folded(node.body)))
        return tuple(out)

    def _fold(self, e):
        if not isinstance(e, Call):
            return e
        args = tuple(self._fold(a) for a in e.args)
        if e.op in ("and", "or"):
            first, second = args
            if isinstance(first, Const):
                return second if bool(first.value) == (e.op == "and") else first
        elif all(isinstance(a, Const) for a in args):
            return Const(self._calls[e.op](*(a.value for a in args)))
        return Call(e.op, args)

    def _value(self, e) -> Callable:
        if isinstance(e, Const):
            return lambda m, loop, v=e.value: v
        if isinstance(e, Get):
            if e.of == "m":
                return lambda m, loop, i=("role", "text").index(e.name): m[i]
            return lambda m, loop, i=LOOP.index(e.name): loop[i]
        parts = [self._value(a) for a in e.args]
        if e.op in ("and", "or"):
            a, b = parts
            return (lambda m, loop: a(m, loop) and b(m, loop)) if e.op == "and" else (lambda m, loop: a(m, loop) or b(m, loop))
        call = self._calls[e.op]
        if len(parts) == 1:
            return lambda m, loop, a=parts[0]: call(a(m, loop))
        a, b = parts
        return lambda m, loop: call(a(m, loop), b(m, loop))

    def _block(self, nodes: tuple) -> Callable:
        steps = [self._node(n) for n in nodes]

        def run(sink: Sink, m, loop) -> None:
            for step in steps:
                step(sink, m, loop)

        return steps[0] if len(steps) == 1 else run

    def _node(self, node) -> Callable:
        if isinstance(node, Emit):
            if isinstance(node.value, Const):
                return lambda sink, m, loop, t=node.value.value: sink.write(t)
            value = self._value(node.value)
            return lambda sink, m, loop: sink.write(_text(value(m, loop)))
        if isinstance(node, If):
            test, then, other = self._value(node.test), self._block(node.then), self._block(node.other)
            return lambda sink, m, loop: (then if test(m, loop) else other)(sink, m, loop)
        body = self._block(node.body)

        def masked(sink: Sink, m, loop) -> None:
            start = sink.size
            body(sink, m, loop)
            if sink.size > start:
                sink.spans.append((start, sink.size))

        return masked

    def render(self, turns: list[tuple[str, str]]) -> Sink:
        """A whole conversation of ``(role, text)`` at once."""
        sink, last = Sink(), len(turns) - 1
        self.head(sink, None, None)
        for i, m in enumerate(turns):
            near = turns[i - 1][0] if i else "", turns[i + 1][0] if i < last else ""
            self.turn(sink, m, (i == 0, i == last, i, *near))
        self.tail(sink, None, None)
        return sink

    def reader(self) -> Callable[[str], list[tuple[str, str]]]:
        """What takes ``(role, text)`` of each turn out of written text.

        Every way through the loop must be texts and guarded fields in turn, the text apart from others by a
        control string first and after every field; the role must be written or fixed by the branch.
        """
        ways = [way for way in self._ways(self.body, None) if way[1]]
        names, patterns = [], []
        for role, items in ways:
            got, pattern = {"role": role}, ""
            for i, item in enumerate(items):
                if isinstance(item, _Literal):
                    pattern += re.escape(item)
                    continue
                after = items[i + 1] if i + 1 < len(items) else None
                if got.get(item) is not None or not isinstance(after, _Literal) or i == 0:
                    raise TemplateError("a field must stand once, between texts")
                self._seam(items[i - 1], after)
                got[item] = len(names) + 1
                names.append(item)
                pattern += "(.*?)"
            if "text" not in got or got["role"] is None or not any(str.startswith(items[0], c) for c in self.guard.controls):
                raise TemplateError("a turn must open with a control string and hold its role and text")
            patterns.append((got, pattern, len(patterns)))
        starts = [items[0] for _, items in ways]
        if any(a != b and a.startswith(b) for a in starts for b in starts) or len(set(starts)) < len(starts):
            raise TemplateError("two kinds of turn open alike")
        whole = re.compile("|".join(f"(?P<w{k}>{p})" for _, p, k in patterns), re.S)
        # a group for each way comes before its fields
        columns, index = {}, whole.groupindex
        for got, _, k in patterns:
            base = index[f"w{k}"]
            fields = sorted(v for v in got.values() if isinstance(v, int))
            place = {v: base + 1 + i for i, v in enumerate(fields)}
            columns[f"w{k}"] = {n: place[v] if isinstance(v, int) else v for n, v in got.items()}
        show = self.guard.show

        def read(text: str) -> list[tuple[str, str]]:
            out, at = [], 0
            while at < len(text):
                m = whole.match(text, at)
                if not m:
                    raise TemplateError(f"no turn at {at}")
                way = columns[next(k for k in columns if m[k] is not None)]
                out.append(tuple(show(m[way[n]]) if isinstance(way[n], int) else way[n] for n in ("role", "text")))
                at = m.end()
            return out

        return read

    def _ways(self, nodes: tuple, role: str | None):
        """Every way through ``nodes``: the role its branches fix, and texts (strings with control strings) and field names."""
        if not nodes:
            yield role, []
            return
        node, rest = nodes[0], nodes[1:]
        if isinstance(node, If):
            t = node.test
            fixed = isinstance(t, Call) and t.op == "==" and t.args[0] == Get("m", "role") and isinstance(t.args[1], Const)
            if not fixed:
                raise TemplateError("only the role may decide how a turn is written")
            yield from self._ways((*node.then, *rest), t.args[1].value)
            yield from self._ways((*node.other, *rest), role)
            return
        inner = (*node.body, *rest) if isinstance(node, Loss) else None
        if inner is not None:
            yield from self._ways(inner, role)
            return
        v = node.value
        if isinstance(v, Const):
            item = _Literal(v.value)
        elif isinstance(v, Call) and v.op == "guard" and isinstance(v.args[0], Get) and v.args[0].of == "m":
            item = v.args[0].name
        else:
            raise TemplateError("only texts and guarded fields can be read back")
        for found, items in self._ways(rest, role):
            if isinstance(item, _Literal) and items and isinstance(items[0], _Literal):
                yield found, [_Literal(item + items[0]), *items[1:]]
            else:
                yield found, [item, *items]

    def _seam(self, before: str, after: str) -> None:
        """A text beside a field must not complete a control string that begins or ends in the field, and the one after must hold one."""
        for c in self.guard.controls:
            for k in range(1, len(c)):
                if after.startswith(c[k:]) or before.endswith(c[:k]) or (c[k:].startswith(after)):
                    raise TemplateError(f"{c!r} could arise where a field meets a text")
        if not any(c in after for c in self.guard.controls):
            raise TemplateError("a control string must follow a field")


class _Literal(str):
    """A text of a template, apart from a field's name."""
