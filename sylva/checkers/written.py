"""Checkers that are functions: forward taint from requests and events to sinks, and JavaScript ones over scopes and data flow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from sylva.plans.checkers import Checker
from sylva.plans.pattern import File, by_field, first_of_kind, named, nth_named, of_kind
from sylva.plans.scopes import IMPORT, DataFlow, Scopes
from sylva.sources.syntax import N

CHECKERS: list[Checker] = []
Issues = Iterator[tuple[N, str]]


def checker(id: str, lang: str, severity: str, category: str = "security"):
    def add(run: Callable[[File], Issues]):
        CHECKERS.append(Checker(id, lang, run=run, severity=severity, category=category, description=(run.__doc__ or "").strip(), origin="builtin"))
        return run

    return add


# taint in Python files
def arguments(f: File, call: N) -> list[N]:
    args = by_field(call, "arguments")
    return named(args) if args is not None and args.kind == "argument_list" else []


def callee(f: File, call: N, kind: str = "attribute") -> str:
    """The text of what is called, if it's of this kind."""
    fn = by_field(call, "function")
    return f.text(fn) if fn is not None and fn.kind == kind else ""


def callee_parts(f: File, call: N) -> tuple[str, str]:
    """object and attribute of a method call on a plain name"""
    fn = by_field(call, "function")
    if fn is None or fn.kind != "attribute":
        return "", ""
    on, member = by_field(fn, "object"), by_field(fn, "attribute")
    return (f.text(on), f.text(member)) if on is not None and on.kind == "identifier" else ("", "")


def assignments(f: File) -> Iterator[tuple[str, N]]:
    for n in f.by_kind["assignment"]:
        left, right = by_field(n, "left"), by_field(n, "right")
        if left is not None and right is not None:
            yield f.text(left), right


def spread(f: File, test: Callable[[N], bool], names: set[str] | None = None) -> set[str]:
    """Names that one pass over the assignments, in order, adds for values that pass the test."""
    names = set() if names is None else names
    for name, value in assignments(f):
        if test(value):
            names.add(name)
    return names


def routed(f: File) -> set[str]:
    """Parameters of functions under a route decorator."""
    out = set()
    for n in f.by_kind["decorated_definition"]:
        first = nth_named(n, 0)
        call = nth_named(first, 0) if first is not None and first.kind == "decorator" else None
        if call is None or call.kind != "call" or not callee(f, call).endswith(".route"):
            continue
        params = by_field(by_field(n, "definition"), "parameters")
        if params is not None:
            out |= {f.text(p) for p in named(params)}
    return out


def from_request(f: File, n: N) -> bool:
    if n.kind == "call":
        return callee(f, n).startswith(("request", "flask.request."))
    value = by_field(n, "value") if n.kind == "subscript" else None
    return value is not None and value.kind == "attribute" and f.text(value).startswith(("request.", "flask.request."))


def inserted(f: File, n: N, hit: Callable[[N], bool]) -> bool:
    """Whether a hit goes into a formatted string by format() or by a hole of an f-string."""
    if n.kind == "call":
        return callee(f, n).endswith(".format") and any(hit(a) for a in arguments(f, n))
    if n.kind == "string" and f.text(n)[:1] == "f":
        return any(e is not None and hit(e) for e in (by_field(k, "expression") for k in of_kind(n, "interpolation")))
    return False


def mentions(f: File, n: N, names: set[str]) -> bool:
    text = f.text(n)
    return any(re.search(rf"\b{re.escape(x)}\b", text) for x in names)


def joined(f: File, n: N, names: set[str], hit: Callable[[N], bool]) -> bool:
    if n.kind != "binary_operator":
        return False
    right = by_field(n, "right")
    if mentions(f, n, names) or right is not None and right.kind == "call" and from_request(f, right):
        return True
    return right is not None and right.kind == "tuple" and any(hit(k) for k in named(right))


def plain(f: File, names: set[str]) -> Callable[[N], bool]:
    return lambda n: n.kind == "identifier" and f.text(n) in names


def plain_or_request(f: File, names: set[str]) -> Callable[[N], bool]:
    return lambda n: n.kind == "identifier" and f.text(n) in names or n.kind == "call" and from_request(f, n)


def user_data(f: File, names: set[str]) -> Callable[[N], bool]:
    """A request, a tainted name, or text made with one."""

    def test(n: N) -> bool:
        if n.kind == "call" and from_request(f, n) and "build_absolute_uri" not in f.text(n):
            return True
        if n.kind == "binary_operator":
            return mentions(f, n, names)
        return inserted(f, n, plain(f, names)) or plain(f, names)(n) or n.kind == "subscript" and from_request(f, n)

    return test


def user_tainted(f: File, names: set[str]) -> Callable[[N], bool]:
    """A tainted name, an item of a request, or text made with a tainted name or a request."""
    hit = plain_or_request(f, names)
    return lambda n: inserted(f, n, hit) or joined(f, n, names, hit) or plain(f, names)(n) or n.kind == "subscript" and from_request(f, n)


def sunk(f: File, message: str, sink: Callable[[N], bool], test: Callable[[N], bool]) -> Issues:
    """An issue for each argument of a sink's call that passes the test."""
    for n in f.by_kind["call"]:
        if sink(n):
            for a in arguments(f, n):
                if test(a):
                    yield n, message


def requested(f: File) -> set[str]:
    """Names that hold a request's data, directly or by text that is made with it."""
    names = spread(f, lambda v: from_request(f, v))
    return spread(f, user_tainted(f, names), names)


@checker("os-system-injection", "python", "error")
def os_system_injection(f: File) -> Issues:
    """os.system with user data"""
    names = routed(f)
    spread(f, user_data(f, names), names)
    return sunk(f, "User data in os.system; run a list of arguments instead", lambda n: callee_parts(f, n) == ("os", "system"), user_data(f, names))


@checker("path-traversal-open", "python", "error")
def path_traversal_open(f: File) -> Issues:
    """open with user data"""
    names = routed(f)
    spread(f, user_data(f, names), names)
    return sunk(f, "User data in the path of a file that is opened", lambda n: f.text(by_field(n, "function")).startswith("open"), user_data(f, names))


@checker("csv-writer-injection", "python", "warning")
def csv_writer_injection(f: File) -> Issues:
    """rows of a csv writer with user data"""
    writers = spread(f, lambda v: v.kind == "call" and callee_parts(f, v) == ("csv", "writer"))
    names: set[str] = set()
    spread(f, user_data(f, names), names)

    def sink(n: N) -> bool:
        on, member = callee_parts(f, n)
        return on in writers and re.search(r"^(writerow|writerows|writeheader)$", member) is not None

    return sunk(f, "User data in a CSV file may hold formulas", sink, user_data(f, names))


@checker("aws-lambda-sqli", "python", "warning")
def aws_lambda_sqli(f: File) -> Issues:
    """SQL made of a lambda's event"""
    cursors, events = set(), set()
    for n in sorted([*f.by_kind["assignment"], *f.by_kind["with_statement"]], key=lambda n: n.pre):
        if n.kind == "assignment":
            left, right = by_field(n, "left"), by_field(n, "right")
            if right is None:
                continue
            if right.kind == "call" and "cursor" in f.text(right):
                cursors.add(f.text(left))
            if right.kind == "subscript" and f.text(right).startswith("event"):
                events.add(f.text(left))
            continue
        clause = first_of_kind(n, "with_clause")
        item = nth_named(clause, 0) if clause is not None else None
        value = by_field(item, "value") if item is not None else None
        if value is not None and value.kind == "as_pattern":
            what, alias = nth_named(value, 0), by_field(value, "alias")
            if what.kind == "attribute" and "cursor" in f.text(what) and alias is not None:
                cursors.add(f.text(alias))

    def dirty(n: N | None) -> bool:
        return n is not None and ("event" in f.text(n) or any(e in f.text(n) for e in events))

    def made(n: N) -> bool:
        if n.kind == "binary_operator":
            return dirty(by_field(n, "right"))
        if n.kind == "string":
            return f.text(n)[:1] == "f" and any(map(dirty, of_kind(n, "interpolation")))
        return n.kind == "call" and f.text(by_field(n, "function")).endswith(".format") and dirty(by_field(n, "arguments"))

    queries = spread(f, made)
    for n in f.by_kind["call"]:
        fn, args = f.text(by_field(n, "function")), arguments(f, n)
        if ("execute" in fn or "mogrify" in fn) and any(c in fn for c in cursors) and len(args) == 1:
            if args[0].kind == "identifier" and any(q in f.text(args[0]) for q in queries) or made(args[0]):
                yield n, "Query made of an event's data"


_EXEC = {"asyncio.subprocess.create_subprocess_exec", "subprocess.create_subprocess_exec", "create_subprocess_exec"}


@checker("dangerous-create-exec", "python", "error")
def dangerous_create_exec(f: File) -> Issues:
    """create_subprocess_exec with data of an event"""

    def item(n: N | None) -> bool:
        return n is not None and n.kind == "subscript" and f.text(by_field(n, "value")) == "event"

    events = {f.text(by_field(n, "left")) for n in f.by_kind["assignment"] if by_field(n, "right") is not None and by_field(n, "left").kind == "identifier" and item(by_field(n, "right"))}

    def dirty(n: N | None) -> bool:
        return n is not None and n.kind == "identifier" and f.text(n) in events

    def shell(n: N | None) -> bool:
        return n is not None and n.kind == "string" and re.search(r"(^|/)?(sh|bash|ksh|csh|tcsh|zsh)$", f.text(n).strip("\"'")) is not None

    message = "Data of an event is executed"
    passes: list[Callable[[list[N]], bool]] = [
        lambda a: bool(named(a[1])) and dirty(named(a[1])[0]),
        lambda a: item(a[1]),
        lambda a: len(a) >= 4 and shell(a[1]) and dirty(a[3]),
        lambda a: len(a) >= 4 and shell(a[1]) and item(a[3]),
        lambda a: a[1].kind == "list" and shell(nth_named(a[1], 0)) and dirty(nth_named(a[1], 2)),
        lambda a: a[1].kind == "list" and shell(nth_named(a[1], 0)) and item(nth_named(a[1], 2)),
    ]
    for test in passes:
        for n in f.by_kind["call"]:
            args = arguments(f, n)
            if f.text(by_field(n, "function")) in _EXEC and len(args) >= 2 and test(args):
                yield n, message


@checker("django-insecure-pickle-deserialize", "python", "warning")
def django_insecure_pickle_deserialize(f: File) -> Issues:
    """deserialising a request"""
    names: set[str] = set()

    def source(n: N) -> bool:
        if n.kind == "call":
            if not f.text(n).startswith("request") and any(source(a) for a in arguments(f, n)):
                return True
            fn = by_field(n, "function")
            return fn.kind == "attribute" and "request" in f.text(by_field(fn, "object")) and by_field(fn, "attribute").kind == "identifier"
        if n.kind == "subscript":
            value = by_field(n, "value")
            on = by_field(value, "object") if value.kind == "attribute" else None
            return on is not None and (on.kind == "identifier" or f.text(on) == "request")
        return plain(f, names)(n)

    spread(f, source, names)
    message = "Data of a request is deserialised"

    def found(test: Callable[[str, str, N], bool]) -> Issues:
        for n in f.by_kind["call"]:
            fn = by_field(n, "function")
            if fn.kind == "attribute" and test(f.text(by_field(fn, "object")), f.text(by_field(fn, "attribute")), n):
                yield from ((n, message) for a in arguments(f, n) if a.kind in ("identifier", "call") and source(a))

    def unsafe(on: str, member: str, n: N) -> bool:
        keywords = [(f.text(by_field(a, "name")), f.text(by_field(a, "value"))) for a in arguments(f, n) if a.kind == "keyword_argument"]
        return on == "yaml" and member in ("dump", "dump_all", "load", "load_all") and not any(k in ("Dumper", "Loader") and ("SafeDumper" in v or "SafeLoader" in v) for k, v in keywords)

    yield from found(lambda on, member, _: on in ("pickle", "_pickle", "cPickle", "shelve", "dill") and member in ("dump", "dumps", "load", "loads", "dump_session", "load_session"))
    yield from found(unsafe)


@checker("django-missing-throttle-config", "python", "warning")
def django_missing_throttle_config(f: File) -> Issues:
    """REST framework without rates"""
    for n in f.by_kind["assignment"]:
        left, right = by_field(n, "left"), by_field(n, "right")
        if right is None or left.kind != "identifier" or f.text(left) != "REST_FRAMEWORK" or right.kind != "dictionary":
            continue
        keys = [by_field(p, "key") for p in of_kind(right, "pair")]
        texts = [f.text(c) for k in keys if k.kind == "string" and f.text(k)[:1] != "f" for c in [nth_named(k, 1)] if c is not None and c.kind == "string_content"]
        if "DEFAULT_THROTTLE_RATES" not in texts:
            yield n, "No rate limits are configured"


@checker("django-password-empty-string", "python", "warning")
def django_password_empty_string(f: File) -> Issues:
    """set_password with an empty string"""
    blank = lambda n: f.text(n) in ('""', "''")

    def empty(n: N) -> bool:
        if n.kind == "call":
            fn, args = callee(f, n), arguments(f, n)
            return bool(fn) and (fn.startswith("request.") or fn.endswith(".get")) and len(args) > 1 and args[1].kind == "string" and blank(args[1])
        return n.kind == "string" and blank(n)

    names = spread(f, empty)
    for n in f.by_kind["function_definition"]:
        for p in of_kind(by_field(n, "parameters"), "default_parameter"):
            if by_field(p, "name").kind == "identifier" and empty(by_field(p, "value")):
                names.add(f.text(by_field(p, "name")))
    return sunk(f, "An empty string as the password", lambda n: callee(f, n).endswith(".set_password"), lambda a: f.text(a) in names or a.kind == "string" and blank(a))


@checker("django-request-data-write", "python", "warning")
def django_request_data_write(f: File) -> Issues:
    """user data written to a file"""
    names = requested(f)
    tainted = user_tainted(f, names)

    def test(n: N) -> bool:
        return n.kind == "call" and any(tainted(a) for a in arguments(f, n)) or tainted(n)

    return sunk(f, "User data is written to a file", lambda n: (callee(f, n) or callee(f, n, "identifier")).endswith("write"), test)


@checker("django-request-httpresponse", "python", "warning")
def django_request_httpresponse(f: File) -> Issues:
    """user data in a response"""
    names = spread(f, lambda v: from_request(f, v))
    made: set[str] = set()
    hit = plain_or_request(f, names)

    def test(n: N) -> bool:
        return inserted(f, n, hit) or joined(f, n, names, hit) or plain(f, names | made)(n) or n.kind == "subscript" and from_request(f, n)

    spread(f, test, made)
    return sunk(f, "User data in a response may hold scripts", lambda n: (callee(f, n) or callee(f, n, "identifier")).endswith(("HttpResponse", "HttpResponseBadRequest")), test)


@checker("django-sql-injection", "python", "warning")
def django_sql_injection(f: File) -> Issues:
    """raw SQL made of user data"""
    cursors = set()
    for name, v in assignments(f):
        fn = by_field(v, "function") if v.kind == "call" else None
        if fn is not None and fn.kind == "attribute" and f.text(by_field(fn, "object")) == "connection" and f.text(by_field(fn, "attribute")) == "cursor":
            cursors.add(name)
    for n in f.by_kind["with_statement"]:
        clause = first_of_kind(n, "with_clause")
        value = by_field(nth_named(clause, 0), "value") if clause is not None and named(clause) else None
        if value is not None and value.kind == "as_pattern":
            call = nth_named(value, 0)
            fn = by_field(call, "function")
            if fn is not None and (fn.kind == "attribute" or f.text(fn) == "connection.cursor"):
                cursors.add(f.text(by_field(value, "alias")))

    def sink(n: N) -> bool:
        fn = by_field(n, "function")
        if re.search(r"\bRawSQL\b", f.text(fn)):
            return True
        return fn.kind == "attribute" and (f.text(by_field(fn, "object")) in cursors and f.text(by_field(fn, "attribute")) == "execute" or f.text(fn).endswith(".objects.raw"))

    return sunk(f, "User data in raw SQL; use parameters", sink, user_tainted(f, requested(f)))


@checker("ssrf-injection", "python", "warning")
def ssrf_injection(f: File) -> Issues:
    """requests to an address made of user data"""
    methods = set()
    for n in f.by_kind["import_from_statement"]:
        if f.text(by_field(n, "module_name")) == "requests":
            methods |= {f.text(nth_named(k, 0)) for k in named(n)[1:] if k.kind == "dotted_name"}
    names = routed(f)
    spread(f, lambda v: from_request(f, v), names)
    spread(f, user_tainted(f, names), names)
    return sunk(f, "User data in a request to another server", lambda n: from_request(f, n) or callee(f, n, "identifier") in methods - {""}, user_tainted(f, names))


@checker("flask-format-string-return", "python", "warning")
def flask_format_string_return(f: File) -> Issues:
    """a route that returns formatted user data"""
    names, made = routed(f), set()
    spread(f, lambda v: from_request(f, v), names)
    hit = lambda n: from_request(f, n) or f.text(n) in names or f.text(n) in made

    def test(n: N) -> bool:
        if n.kind == "call":
            return callee(f, n).endswith(".format") and any(map(hit, arguments(f, n)))
        if n.kind == "binary_operator":
            left, right = by_field(n, "left"), by_field(n, "right")
            return left.kind == "string" and (right.kind == "identifier" and hit(right) or right.kind == "tuple" and any(map(hit, named(right))))
        if n.kind == "string":
            return any(hit(e) for e in (nth_named(k, 0) for k in of_kind(n, "interpolation")) if e is not None)
        return n.kind == "identifier" and f.text(n) in names | made

    spread(f, test, made)
    for n in f.by_kind["return_statement"]:
        value = nth_named(n, 0)
        if value is not None and test(value):
            yield n, "Formatted user data is returned; render a template instead"


@checker("insecure-urllib-ftp", "python", "error")
def insecure_urllib_ftp(f: File) -> Issues:
    """urllib on an ftp address"""
    ftp = lambda n: re.search(r"(?i)^ftp://.*", f.text(n).strip('"')) is not None
    urls, openers = set(), set()
    for n in f.by_kind["function_definition"]:
        urls |= {f.text(by_field(p, "name")) for p in of_kind(by_field(n, "parameters"), "default_parameter") if ftp(by_field(p, "value"))}
    for name, v in assignments(f):
        text = f.text(v)
        if v.kind in ("string", "call") and text[:1] != "f":
            if ftp(v):
                urls.add(name)
            if any(x in text for x in ("OpenerDirector", "Request", "URLopener")):
                openers.add(name)
    for n in f.by_kind["call"]:
        fn, args = f.text(by_field(n, "function")), arguments(f, n)
        if args and any(x in fn for x in ("OpenerDirector", "Request", "urlopen", "URLopener", "urlretrieve", *openers)):
            if args[0].kind == "string" and ftp(args[0]) or args[0].kind == "identifier" and f.text(args[0]) in urls:
                yield n, "FTP isn't encrypted; use SFTP instead"


@checker("nan-injection", "python", "warning")
def nan_injection(f: File) -> Issues:
    """user data cast to a number"""
    names = routed(f)
    spread(f, lambda v: from_request(f, v), names)

    def cast(n: N | None) -> bool:
        value = by_field(n, "right") if n is not None and n.kind == "assignment" else n
        if value is None or value.kind != "call" or callee(f, value, "identifier") not in ("float", "complex", "bool"):
            return False
        args = arguments(f, value)
        return bool(args) and (from_request(f, args[0]) or plain(f, names)(args[0]))

    for n in f.by_kind["function_definition"]:
        checked = False
        for k in named(by_field(n, "body")):
            if k.kind == "if_statement":
                checked = checked or mentions(f, by_field(k, "condition"), names)
            elif k.kind == "expression_statement" and cast(nth_named(k, 0)) and not checked:
                yield k, "User data is cast to a number and may be NaN"


# JavaScript
@checker("no-double-eq", "javascript", "warning", "bug-risk")
def no_double_eq(f: File) -> Issues:
    """=="""
    for n in f.by_kind["binary_expression"]:
        o = by_field(n, "operator")
        if o is not None and f.text(o) == "==":
            yield o, "Do not use '==' for comparison. Prefer '===' instead."


@checker("unused-import", "javascript", "info", "antipattern")
def unused_import(f: File) -> Issues:
    """imports that nothing refers to"""
    for _, v in f.ask(Scopes).all():
        if v.kind == IMPORT and not v.refs:
            yield v.decl, f'unused import "{v.name}"'


@checker("no_exec", "javascript", "critical")
def no_exec(f: File) -> Issues:
    """calls of functions that hand something to a sink"""
    flow = f.ask(DataFlow)

    def sinks(n: N) -> bool:
        for x in n.walk():
            fn = by_field(x, "function") if x.kind == "call_expression" else None
            member = by_field(fn, "property") if fn is not None and fn.kind == "member_expression" else None
            args = by_field(x, "arguments") if member is not None else None
            if args is not None and f.text(member) == "log" and named(args):
                return True
        return False

    unsafe = {name for name, fn in flow.functions.items() if sinks(fn.node)}
    for n in f.by_kind["call_expression"]:
        fn = by_field(n, "function")
        if fn is not None and fn.kind == "identifier" and f.text(fn) in unsafe:
            yield n, "Potentially unsafe function call with tainted input"


@checker("sha1_detector", "javascript", "warning")
def sha1_detector(f: File) -> Issues:
    """SHA-1 of a hash library"""
    scopes, found = f.ask(Scopes), []
    for n in f.nodes:
        own = None
        if n.kind == "variable_declarator":
            own = by_field(n, "name")
        elif n.kind == "import_statement":
            source = by_field(n, "source")
            text = nth_named(source, 0) if source is not None else None
            clause = nth_named(n, 0)
            if text is not None and f.text(text) == "jssha" and clause.kind == "import_clause":
                own = nth_named(clause, 0)
        if own is not None and own.kind == "identifier":
            v = scopes.scope(n).lookup(f.text(own))
            if v is not None:
                found.append(v)
    for n in f.by_kind["new_expression"]:
        made, args = by_field(n, "constructor"), by_field(n, "arguments")
        first = nth_named(args, 0) if made is not None and args is not None else None
        text = nth_named(first, 0) if first is not None else None
        if text is not None and f.text(text) == "SHA-1" and scopes.scope(made).lookup(f.text(made)) in found:
            yield n, "SHA-1 is not recommended for cryptographic purposes"


@checker("sql_injection", "javascript", "critical")
def sql_injection(f: File) -> Issues:
    """queries that are joined from parts"""
    values = {f.text(by_field(n, "name")): by_field(n, "value") for n in f.by_kind["variable_declarator"] if by_field(n, "name").kind == "identifier" and by_field(n, "value") is not None}

    def unsafe(n: N | None, seen: frozenset[str] = frozenset()) -> bool:
        if n is None:
            return False
        if n.kind == "binary_expression":
            sides = by_field(n, "left"), by_field(n, "right")
            return any(s is not None and s.kind == "identifier" for s in sides) or any(unsafe(s, seen) for s in sides)
        if n.kind == "template_string":
            return bool(of_kind(n, "template_substitution"))
        if n.kind == "identifier":
            name = f.text(n)
            return name not in seen and (name not in values or unsafe(values[name], seen | {name}))
        return False

    for n in f.by_kind["call_expression"]:
        fn = by_field(n, "function")
        member = by_field(fn, "property") if fn is not None and fn.kind == "member_expression" else None
        args = by_field(n, "arguments")
        if member is not None and args is not None and f.text(member) in ("query", "raw", "$queryRawUnsafe", "$executeRawUnsafe") and unsafe(nth_named(args, 0)):
            yield n, "Potential SQL injection vulnerability detected, use parameterized queries instead"
