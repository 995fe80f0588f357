"""Declarative checkers as trees of node tests.

T builds a node test: keyword arguments are fields, `is_` a text that the node must have, `like` a regular
expression that it must match, `unlike` one that it mustn't. rule() reports what its last tests match.
"""

from __future__ import annotations

import re

from sylva.plans.checkers import _WITHIN, Checker
from sylva.plans.pattern import Node, Pattern

_TESTS = {"go": ["test/**", "*_test.go"], "javascript": ["test/**", "*_test.js"], "ruby": ["test/**", "*_test.rb"]}
_EXCLUDED = {k: [*v, "tests/**", "__tests__/**"] for k, v in _TESTS.items()} | {
    "java": ["tests/**", "vendor/**", "**/Test_*.java", "**/*Test.java"],
    "php": ["tests/**", "vendor/**", "**/test_*.php", "**/*_test.php"],
    "rust": ["tests/**", "vendor/**", "**/test_*.rs", "**/*_test.rs"],
}
RULES: list[Checker] = []


def T(kind, *below: Node, is_: str | None = None, like: str | None = None, unlike: str | None = None, first: bool = False, maybe: bool = False, cap: str | None = None, **fields: Node) -> Node:
    kids = []
    for f, n in fields.items():
        n.field = f
        kids.append(n)
    test = re.compile(f"^(?:{re.escape(is_)})$") if is_ is not None else re.compile(like) if like else None
    return Node(kind, test=test, unless=re.compile(unlike) if unlike else None, children=[*kids, *below], anchored=first, quantifier="?" if maybe else "", captures=[cap] if cap else [])


def either(*ways: Node, first: bool = False) -> Node:
    return Node(list(ways), anchored=first)


def group(*members: Node) -> Node:
    return Node("", children=list(members))


def rule(id: str, lang: str, message: str, *roots: Node, category: str = "security", severity: str = "critical", inside: Node | None = None, outside: tuple[Node, ...] = (), exclude: list[str] | None = None, where: tuple = (), inner: bool = False) -> None:
    for r in roots:
        if not inner:
            r.captures.append(id)
    filters = []
    for keep, around in [(True, inside)] * (inside is not None) + [(False, o) for o in outside]:
        around.captures.append(_WITHIN)
        filters.append((keep, [Pattern(around, [])]))
    RULES.append(Checker(id, lang, message, [Pattern(r, list(where)) for r in roots], category, severity, filters=filters, exclude=_EXCLUDED.get(lang, []) if exclude is None else exclude, origin="builtin"))


# Dockerfile
rule("avoid_add", "dockerfile", "Use COPY instead of ADD", T("add_instruction"), category="antipattern", severity="warning")
rule("avoid_latest", "dockerfile", "Pin the image to a version instead of latest", T("from_instruction", T("image_spec", name=T("image_name"), tag=T("image_tag", is_=":latest"))), category="bug-risk", severity="warning")
rule("avoid_sudo", "dockerfile", "Commands of an image need no sudo", T("run_instruction", T("shell_command", T("shell_fragment", like="^(sudo)", cap="sudo"))), category="antipattern", severity="warning")


# Go
def go(id: str, message: str, *roots: Node, **kw) -> None:
    rule(id, "go", message, *roots, **kw)


def selected(package: str, like: str, kind: str = "identifier") -> Node:
    return T("selector_expression", operand=T(kind, is_=package), field=T("field_identifier", like=like))


def go_call(package: str, like: str, arguments: Node | None = None) -> Node:
    return T("call_expression", function=selected(package, like), **({"arguments": arguments} if arguments else {}))


def go_import(path: str) -> Node:
    return T("import_spec", path=T("interpreted_string_literal", is_=f'"{path}"'))


def of_type(package: str, type_: str, **more: Node) -> Node:
    return T("composite_literal", type=T("qualified_type", package=T("package_identifier", is_=package), name=T("type_identifier", is_=type_)), **more)


def declared(right: Node, left: Node | None = None) -> Node:
    sides = {"left": left} if left else {}
    return T("short_var_declaration", **sides, right=T("expression_list", right))


for _id, _path, _severity in [("go_cgi_import", "net/http/cgi", "critical"), ("go_math_rand", "math/rand", "critical"), ("go_md5_weak_hash", "crypto/md5", "critical"), ("go_reflect_pkg", "reflect", "warning"), ("go_unsafe_pkg", "unsafe", "warning")]:
    go(_id, f"Import of {_path}", go_import(_path), severity=_severity)
go("go_pprof_endpoint_automatic_exposure", "Blank import of net/http/pprof serves profiles to anyone", T("import_spec", name=T("blank_identifier"), path=T("interpreted_string_literal", like='"net/http/pprof"')), severity="warning")
go("go_des_weak_crypto", "DES is a weak cipher", go_call("des", "^(NewTripleDESCipher|NewCipher)$"))
go("go_fmt_print_in_prod", "Log instead of printing", go_call("fmt", "Println|Printf|Print"), category="best-practice", severity="warning")
go("go_grpc_client_insecure_tls", "gRPC connection without TLS", go_call("grpc", "^Dial$", T("argument_list", go_call("grpc", "^WithInsecure$"))))
go("go_grpc_server_insecure_tls", "gRPC server without credentials", declared(go_call("grpc", "^NewServer$", T("argument_list", unlike="Creds"))))
go("go_http_file_server", "File server over a directory", go_call("http", "^FileServer$", T("argument_list", go_call("http", "^Dir$"))))
_cookie = lambda **body: go_call("http", "^SetCookie$", T("argument_list", T("unary_expression", of_type("http", "Cookie", body=T("literal_value", **body)))))
go("go_insecure_cookie", "Cookie without Secure", _cookie(unlike="Secure.*true"))
go("go_samesite_cookie", "Cookie without a strict or lax SameSite", _cookie(unlike="SameSiteLaxMode|SameSiteStrictMode"))
go("go_jwt_harcoded_signing_key", "Signing key in the source", T("call_expression", function=T("selector_expression", operand=T(None), field=T("field_identifier", is_="SignedString")), arguments=T("argument_list", like='".*"')))
go("go_jwt_none_algorithm", "Token without a signature", selected("jwt", "^(SigningMethodNone|UnsafeAllowNoneSignatureType)$"))
go("go_missing_error_file_open", "Error of opening a file is dropped", declared(go_call("os", "^Open"), T("expression_list", T("identifier"), T("identifier", is_="_"))), category="best-practice", severity="warning")
go("go_os_create_file_default_permission", "File created with default permissions", declared(go_call("os", "^Create$", T("argument_list", T("identifier"))), T("expression_list", T("identifier"), T("identifier"))))
go("go_mysql_conn_raw_passwd", "Password in a connection string", go_call("sql", "^Open$", T("argument_list", T("interpreted_string_literal", like='^".*:.*@.*"$', cap="conn"))))
go("go_postgres_conn_raw_passwd", "Password in a connection string", go_call("sql", "^Open$", T("argument_list", T(None), T("interpreted_string_literal", like='^"postgres://.*:.*@.*"$'))))
go("go_postgres_config_raw_passwd", "Password in the options", of_type("pg", "Options", body=T("literal_value", T("keyed_element", T("literal_element", is_="Password"), T("literal_element", T("interpreted_string_literal"))))))
go("go_net_bind_all_interfaces", "Listens on all interfaces", go_call("net", "^Listen$", T("argument_list", T("interpreted_string_literal"), T("interpreted_string_literal", like=r'"(0\.0\.0\.0.*|:.*)"'))), severity="warning")
_config = lambda **body: declared(T("unary_expression", operand=of_type("tls", "Config", body=T("literal_value", **body))))
go("go_tls_config_minver", "TLS configuration without MinVersion", _config(unlike="MinVersion"))
go("go_tls_insecure", "TLS certificates aren't verified", _config(like=r"InsecureSkipVerify.*true"))
_method = lambda like: T("call_expression", function=T("selector_expression", operand=T("identifier"), field=T("field_identifier", is_=like)))
go("go_sha1_weak_hash", "SHA-1 is a weak hash", group(declared(go_call("sha1", "^New$"), T("expression_list", T("identifier"))), T("expression_statement", _method("Write")), declared(_method("Sum"))))
go(
    "html_req_template_injection",
    "Input of a request goes into a template",
    group(
        declared(T("call_expression", function=T(None, like=r"(r.Cookie|r.URL.Query\(\).Get|r.FormValue)")), T("expression_list", T("identifier", cap="in"))),
        declared(T("composite_literal", type=T("map_type"), body=T("literal_value", T("keyed_element", T("literal_element", T("interpreted_string_literal")), T("literal_element", T("identifier", cap="value"))))), T("expression_list", T("identifier", cap="data"))),
        T("assignment_statement", left=T("expression_list", T("identifier")), right=T("expression_list", T("call_expression", function=T("selector_expression", operand=T("identifier"), field=T("field_identifier", is_="Execute")), arguments=T("argument_list", T(None), T(None, cap="sent"))))),
    ),
    where=(("#eq?", ["@value", "@in"]), ("#eq?", ["@sent", "@data"])),
)


# Java
def java(id: str, message: str, *roots: Node, severity: str = "warning", **kw) -> None:
    rule(id, "java", message, *roots, severity=severity, **kw)


def literal(like: str | None = None, unlike: str | None = None) -> Node:
    return T("argument_list", T("string_literal", T("string_fragment", like=like, unlike=unlike)))


def instance(of: str, **tests) -> Node:
    return T("method_invocation", object=T("identifier", is_=of), name=T("identifier", is_="getInstance"), arguments=literal(**tests))


java("cbc-padding-oracle", "CBC with PKCS5 padding can be decrypted by an oracle", instance("Cipher", like="CBC.*PKCS5Padding"), severity="critical")
java("ecb-cipher", "ECB shows patterns of the plain text", instance("Cipher", like="ECB"))
java("rsa-no-padding", "RSA without padding", instance("Cipher", like="RSA/[Nn][Oo][Nn][Ee]/NoPadding"))
java("weak-ssl-context", "Outdated protocol of an SSL context", instance("SSLContext", unlike=r"^(TLSv1.3|TLSv1.2)$"))
java("deprecated-des", "DES is outdated", instance("Cipher", like="^(DES/.*|DESede/.*|DES)$"), T("method_invocation", object=Node("method_invocation", test=re.compile(r"\.[Kk]eyGenerator\.getInstance[\s\S]*\"DES\""))))
java("custom-digests", "A digest of one's own", T("class_declaration", superclass=T("superclass", is_="extends MessageDigest")))
java("deprecated-default-httpclient", "DefaultHttpClient knows no TLS 1.2", T("object_creation_expression", type=T("type_identifier", is_="DefaultHttpClient")))
_part = lambda x: T("type_identifier", is_=x)
java("no-null-cipher", "NullCipher doesn't encrypt", T("object_creation_expression", type=either(_part("NullCipher"), T("scoped_type_identifier", T("scoped_type_identifier", _part("javax"), _part("crypto")), _part("NullCipher")))))
java(
    "sha224-usage",
    "Digests of 224 bits are short",
    T("method_invocation", name=T("identifier", like="^(getSha3_224Digest|getSha512_224Digest|sha3_224|sha3_224Hex|sha512_224|sha512_224Hex)$")),
    T("method_invocation", object=T("object_creation_expression", type=_part("DigestUtils"), arguments=T("argument_list", T("identifier", like="^(.*SHA_224|.*SHA_512_224|.*SHA3_224)$")))),
    T("method_invocation", name=T("identifier", is_="getInstance"), arguments=literal(like=".*224")),
)
java(
    "unsafe_path_traversal",
    "A path is made of input",
    T(
        "object_creation_expression",
        type=_part("File"),
        arguments=T(
            "argument_list",
            either(
                T("identifier", cap="input"),
                T("binary_expression", left=either(T("identifier", cap="input"), T("string_literal"), T("binary_expression")), right=either(T("identifier", cap="input"), T("string_literal"))),
                T("method_invocation", object=T("identifier", is_="String"), name=T("identifier", is_="format"), arguments=T("argument_list", T("string_literal"), T("identifier", cap="input"))),
            ),
            cap="unsafe_path_traversal",
        ),
    ),
    severity="critical",
    inner=True,
)


# JavaScript
def js(id: str, message: str, *roots: Node, **kw) -> None:
    rule(id, "javascript", message, *roots, category="best-practices", severity="warning", **kw)


for _f in ("alert", "confirm", "prompt"):
    js(f"js_{_f}_in_prod", f"{_f}() in production", T("call_expression", function=either(T("identifier", is_=_f), T("member_expression", object=T("identifier", is_="window"), property=T("property_identifier", is_=_f)))))
js("js_debugger_in_prod", "debugger in production", T("debugger_statement"))
js("js_undefined_assignment", "Assignment of undefined", T("assignment_expression", left=T("undefined")), T("variable_declarator"))


def _lazy() -> Node:
    call = lambda: T("call_expression", function=T("identifier", is_="require"))
    ways = [T("lexical_declaration", T("variable_declarator", value=call()), cap="js_lazy_load_module"), T("expression_statement", T("assignment_expression", right=call()), cap="js_lazy_load_module")]
    return T("statement_block", either(*ways))


js("js_lazy_load_module", "Module required within a function", T("function_declaration", body=_lazy()), T("variable_declarator", value=either(T("function_expression", body=_lazy()), T("arrow_function", body=_lazy()))), inner=True)


# PHP and Rust
def _eval(argument: Node) -> Node:
    return T("expression_statement", T("function_call_expression", function=T("name", is_="eval"), arguments=T("arguments", T("argument", argument))))


_text = lambda: T("encapsed_string")
rule(
    "dangerous_eval",
    "php",
    "eval of what isn't constant",
    _eval(T("variable_name", cap="input")),
    _eval(T("binary_expression", left=either(_text(), T("binary_expression")), right=either(_text(), T("variable_name", cap="input")))),
    _eval(T("encapsed_string", T("variable_name", cap="input"))),
    _eval(T("subscript_expression", T("variable_name", T("name", like="^_(GET|POST|REQUEST|COOKIE|SERVER|ENV|FILES|SESSION)$")))),
)
rule("avoid_unwrap", "rust", "unwrap panics", T("call_expression", function=T("field_expression", value=T(None), field=T("field_identifier", is_="unwrap")), arguments=T("arguments")), category="antipattern", severity="warning")


# Python
def py(id: str, message: str, *roots: Node, severity: str = "", category: str = "security", exclude: list[str] | None = None, **kw) -> None:
    rule(id, "python", message, *roots, severity=severity, category=category, exclude=exclude or [], **kw)


def name(is_: str | None = None, like: str | None = None) -> Node:
    return T("identifier", is_=is_, like=like)


def attr(of: Node, member: Node) -> Node:
    return T("attribute", object=of, attribute=member)


def dotted(path: str) -> Node:
    *head, last = path.split(".")
    return attr(dotted(".".join(head)), name(last)) if head else name(last)


def call(function: Node, *arguments: Node) -> Node:
    return T("call", function=function, **({"arguments": T("argument_list", *arguments)} if arguments else {}))


def keyword(key: str, value: Node) -> Node:
    return T("keyword_argument", name=name(key), value=value)


def quoted(is_: str) -> Node:
    return T("string", T("string_content", is_=is_))


def formatted() -> Node:
    return T("string", T("interpolation", T(None)))


def format_of(*arguments: Node) -> Node:
    return call(attr(T("string"), name("format")), *arguments)


py("app-run-with-bad-host", "Flask listens on all interfaces", call(dotted("app.run"), either(keyword("host", quoted("0.0.0.0")), quoted("0.0.0.0"))), severity="warning")
py("avoid-marksafe", "mark_safe turns escaping off", call(name("mark_safe"), either(formatted(), T("binary_operator", left=T("string"), right=T(None)), format_of(T(None)))))
py("avoid-assert", "assert is left out by python -O", T("assert_statement"), category="bug-risk", severity="info", exclude=["test/**", "*_test.py", "tests/**", "*test_*.py"])
py("autoescape-off", "Autoescape is off", T("dictionary", T("pair", key=quoted("autoescape"), value=T("false"))))
py("csrf-exempt", "View without CSRF protection", T("decorated_definition", T("decorator", name("csrf_exempt"))), T("decorated_definition", T("decorator", dotted("django.views.decorators.csrf.csrf_exempt"))))
py("distributed-security-required-encryption", "Dask without encryption", call(name(), keyword("require_encryption", T("false"))), call(dotted("distributed.security.Security"), keyword("require_encryption", T("false"))), category="")
py("django-class-custom-extends", "Subclass of an expression of Django", T("class_definition", name=name(), superclasses=T("argument_list", T("identifier", like=r"^(django\.db\.models\.(expressions\.)?)?(Func|Expression|Value|DurationValue|RawSQL|Star|Random|Col|Ref|ExpressionList|ExpressionWrapper|When|Case|Window|WindowFrame|RowRange|ValueRange|Subquery|Exists)$", cap="base"))), severity="warning")
py("empty-aes-key", "Empty key of AES", call(dotted("AES.new"), Node("string", children=[Node("string_start"), Node("string_end", anchored=True)], anchored=True)))
py("filter-issafe", "Filter marked as safe", T("decorated_definition", T("decorator", call(dotted("register.filter"), keyword("is_safe", T("true"))))), category="")
_main = T("if_statement", condition=T("comparison_operator", name("__name__"), quoted("__main__")))
py("flask-avoid-direct-app-run", "app.run() at top level", call(dotted("app.run")), severity="warning", outside=(_main, T("function_definition")))
py("flask-debug-enabled", "Flask in debug mode", call(attr(name(), name()), keyword("debug", T("true"))), severity="warning")
_outer = call(attr(call(name(), T("string")), name()))
_outer.children.append(Node("argument_list", field="arguments"))
py("format-html-param", "Formatted string as the format of format_html", call(name("format_html"), either(T("binary_operator", left=T("string"), right=name()), formatted(), _outer, call(attr(T("string"), name()), T(None)), name(), first=True)))
_globals = lambda: T("call", function=name("globals"), arguments=T("argument_list"))
py("globals-as-template-context", "globals() as the context of a template", call(name("render"), _globals()), call(dotted("Template.render"), _globals()), severity="error")
py("insecure-cipher-arc4", "Weak cipher", call(name("Cipher"), call(attr(name("algorithms"), name(like="^(ARC4|Blowfish|IDEA|)$")), T(None, cap="key"))))
py("insecure-hash-sha1", "Weak hash", call(attr(name("hashes"), name(like="^(SHA1|MD5)$"))), category="")
_small = r"^(?:[0-1]?[0-9]{1,3}|1[0-9]{3}|20[0-3][0-9]|204[0-7])$"
_bits = lambda: T("integer", like=_small, cap="bits")
_curve = lambda: attr(name("ec"), name(like="^(SECP192R1|SECT163K1|SECT163R2)$"))
_curve_by_name = T("keyword_argument", name=name(), value=_curve())
_generate = lambda of, *args: call(dotted(f"{of}.generate_private_key"), *args)
py("insufficient-keysize", "Key of too few bits", _generate("ec", either(_curve_by_name, _curve())), _generate("dsa", either(keyword("key_size", _bits()), _bits())), _generate("rsa", keyword("key_size", _bits())), _generate("rsa", T(None), _bits()))
py("jwt-python-none-alg", "Token without a signature", call(dotted("jwt.encode"), keyword("algorithm", quoted("none"))), call(dotted("jwt.decode"), keyword("algorithms", T("list", quoted("none")))))
_checked = T("if_statement", condition=call(attr(name(), name("is_valid")), ))
_checked.children[0].children.append(Node("argument_list", field="arguments"))
py("post-after-isvalid", "Raw form data after validation", T("subscript", value=dotted("request.POST"), subscript=T(None)), call(attr(dotted("request.POST"), name("get"))), inside=_checked)
_select = T("argument_list", T("keyword_argument", name=T("identifier", cap="select"), value=T(None)), maybe=True)
py("query-set-extra", "QuerySet.extra takes raw SQL", T("call", function=T("attribute", attribute=name("extra")), arguments=_select), where=(("#not-eq?", ["@select", '"select"']),))
_safe = "^(SafeString|SafeText|SafeData)$"
_extends = lambda of: T("class_definition", name=name(), superclasses=T("argument_list", of))
py("safe-string-extend", "Subclass of a safe string", _extends(attr(dotted("django.utils.safestring"), name(like=_safe))), _extends(name(like="^(SafeString|SafeText|SafeData$)")), _extends(attr(name(), name(is_=_safe))))
_event = lambda: Node("subscript", children=[T("identifier", is_="event")])
_event_item = lambda: T("subscript", value=name("event"))
_from_event = lambda: either(_event_item(), T("string", T("interpolation", expression=_event_item())), T("binary_operator", left=T("string"), right=_event_item()), format_of(_event_item()))
_loader = attr(name(like="^(_pickle|cPickle|pickle|dill|shelve)$"), name(like="^(load|loads|open)$"))
_handler = T("function_definition", name=name(like="handler"), parameters=T("parameters", name("event")))
py("tainted-pickle-deserialize", "Pickle of a lambda's event", call(_loader, _from_event()), call(call(name("loads"), _from_event()), T(None)), inside=_handler)
py("use-ftp-tls", "FTP isn't encrypted", T("call", function=T("attribute", like="^(ftplib.FTP|FTP)$")))
py("weak-ssl-version", "Outdated version of SSL", attr(name("ssl"), name(like="^(PROTOCOL_SSLv2|PROTOCOL_SSLv3|PROTOCOL_TLSv1|PROTOCOL_TLSv1_1)$")), attr(name("SSL"), name(like="^(SSLv2_METHOD|SSLv23_METHOD|SSLv3_METHOD|TLSv1_METHOD|TLSv1_1_METHOD)$")))


# Ruby
def ruby(id: str, message: str, *roots: Node, **kw) -> None:
    rule(id, "ruby", message, *roots, **kw)


def const(path: str) -> Node:
    *head, last = path.split("::")
    return T("scope_resolution", scope=const("::".join(head)), name=T("constant", is_=last)) if head else T("constant", is_=last)


def send(path: str) -> Node:
    *head, last = path.split(".")
    on = {"receiver": T("constant", is_=head[0]) if head[0][:1].isupper() and len(head) == 1 else send(".".join(head)) if len(head) > 1 else T("identifier", is_=head[0])} if head else {}
    return T("call", **on, method=T("identifier", is_=last))


def with_arguments(n: Node, *arguments: Node) -> Node:
    args = T("argument_list", *arguments)
    args.field = "arguments"
    n.children.append(args)
    return n


def pair(key: str, value: Node) -> Node:
    return T("pair", key=T("hash_key_symbol", like=key), value=value)


for _id, _path, _what in [("ruby_dsa_weak_crypto", "OpenSSL::PKey::DSA", "DSA is weak"), ("ruby_rsa_weak_crypto", "OpenSSL::PKey::RSA", "RSA without padding is weak"), ("ruby_md5_weak_hash", "Digest::MD5", "MD5 is weak"), ("ruby_sha1_weak_hash", "Digest::SHA1", "SHA-1 is weak"), ("ruby_ssl_no_verify", "OpenSSL::SSL::VERIFY_NONE", "Certificates aren't verified")]:
    ruby(_id, _what, const(_path))
ruby("ruby_blowfish_weak_crypto", "Blowfish is weak", T("call", receiver=const("Crypt::Blowfish")))
ruby("ruby_eval_method", "eval runs any text", T("call", method=T("identifier", is_="eval")))
ruby("ruby_force_ssl", "TLS isn't forced", T("assignment", left=T("call", method=T("identifier", is_="force_ssl")), right=T("false")), severity="warning")
ruby("ruby_rails_http_hardcoded_passwd", "Password in the source", with_arguments(send("http_basic_authenticate_with"), pair("password", T("string", like='^".*"$'))))
_store = lambda: send("Rails.application.config.session_store")
ruby("ruby_rails_httponly_cookie", "Session cookie for scripts", with_arguments(_store(), T("simple_symbol"), pair("httponly", T(None, like="false"))))
_smtp = lambda value: T("assignment", left=send("config.action_mailer.smtp_settings"), right=T("hash", pair("^openssl_verify_mode$", value)))
ruby("ruby_rails_insecure_smtp", "Mail server isn't verified", _smtp(const("OpenSSL::SSL::VERIFY_NONE")), _smtp(T("string", T("string_content", is_="none"))))
_unset = with_arguments(_store(), T("simple_symbol"))
_unset.children[-1].unless = re.compile("same_site")
ruby("ruby_rails_samesite_cookie", "Session cookie without SameSite", with_arguments(_store(), T("simple_symbol"), pair("^same_site$", T("simple_symbol", is_=":none"))), _unset)
ruby("ruby_rails_unsafe_direct_assignment", "All attributes may be assigned", with_arguments(send("attr_accessible"), T("simple_symbol", is_=":all")))
ruby("ruby_skip_authorization", "Authorization is skipped", T("identifier", like="^skip_authorization_check"))
