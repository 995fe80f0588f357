"""The engine's own operators against small cases and brute force."""

import random
import re
import subprocess

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylva.checkers import builtin
from sylva.checkers.examples import EXAMPLES
from sylva.functions.text import glob_regex
from sylva.operators import issues as ops
from sylva.plans import project, tables
from sylva.plans.checkers import Checker, check, closure, issues_of, load, valid
from sylva.plans.pattern import File, PatternSyntaxError, all_by_field, ancestors, by_field, descendants, first_of_kind, first_where, named, nth_named, of_kind, parse, previous, visit
from sylva.plans.scopes import DataFlow, Scopes, Variable
from sylva.sources import frontends
from sylva.sources.languages import list_tree, read_tree
from sylva.sources.syntax import rows

PAGE = '<html><!-- hi --><body><ul><li><a href="/x">één</a><li><b>two</b></ul>\n<script>var t="</p>";</script><b>out</b></p></body></html>'


def parsed(lang, source):
    return File(*frontends.tree(lang, source))


def files_of(spark, *sources):
    return spark.createDataFrame([(i, f"src/f{i}", lang, s) for i, (lang, s) in enumerate(sources)], "file_id bigint, path string, lang string, source string")


def captured(f, pattern, name="x"):
    return [f.text(n) for p in parse(pattern) for b in f.matches(p) for c, n in b if c == name]


# front ends
@pytest.mark.parametrize("of", sorted(EXAMPLES))
def test_every_checker_on_its_example(of):
    lang, bad, want, good = EXAMPLES[of]
    (c,) = [c for c in builtin() if c.id == of]
    for source, lines in ((bad, want), (good, [])):
        f = parsed(lang, source)
        assert not f.by_kind["ERROR"] and sorted(r[0] for r in issues_of(f, [c], "src/x")) == lines


def test_checkers_are_known_and_complete():
    ids = [c.id for c in builtin()]
    assert len(ids) == len(set(ids)) == 103 and set(ids) == set(EXAMPLES)


def trees():
    for _, (lang, bad, _, good) in EXAMPLES.items():
        yield lang, bad
        yield lang, good
    yield "html", PAGE


def test_nodes_nest_and_are_in_order():
    for lang, source in trees():
        f = parsed(lang, source)
        for n in f.nodes:
            assert 0 <= n.start <= n.end <= len(f.src)
            assert all(n.start <= k.start and k.end <= n.end for k in n.kids), (lang, n)
            assert all(a.end <= b.start for a, b in zip(n.kids, n.kids[1:], strict=False)), (lang, n)


def test_intervals_are_parent_chains():
    for lang, source in list(trees())[::17]:
        r = rows(*frontends.tree(lang, source))
        for a in r:
            for d in r:
                up, found = d[1], False
                while up is not None:
                    found |= up == a[0]
                    up = r[up][1]
                assert found == (a[9] < d[9] <= a[10])


@pytest.mark.parametrize("lang", sorted(frontends.PARSERS))
def test_any_text_is_read(lang):
    rng = random.Random(lang)
    words = ["(", ")", "{", "}", "[", "]", "'", '"', "`", "\n", "  ", "if", "def", "func", "é", "=", "=>", ".", ",", ":", ";", "#", "//", "/*", "<a", ">", "a", "1", "f'{", "${", "\\", "end", "do", "<?php", "<<A", "/"]
    for _ in range(150):
        source = "".join(rng.choice(words) for _ in range(rng.randrange(40)))
        f = parsed(lang, source)
        assert f.nodes[0].end == len(f.src)
    for source in ("", "\n", "(" * 3000, "a " * 20000):
        parsed(lang, source)
    assert frontends.tree(lang, None) is None and frontends.tree("markdown", "x") is None


@pytest.mark.parametrize(
    "lang,source,tree",
    [
        ("python", "a = b.c(d, e=1)", "(module (expression_statement (assignment left: (identifier) right: (call function: (attribute object: (identifier) attribute: (identifier)) arguments: (argument_list (identifier) (keyword_argument name: (identifier) value: (integer)))))))"),
        ("python", "f'a{b:>3}c' if not x in y else -z ** 2", "(module (expression_statement (conditional_expression (string (string_start) (string_content) (interpolation expression: (identifier)) (string_content) (string_end)) (not_operator argument: (comparison_operator (identifier) (identifier))) (unary_operator argument: (binary_operator left: (identifier) right: (integer))))))"),
        ("go", "var a = []byte(\"x\")", '(source_file (var_declaration (var_spec name: (identifier) value: (expression_list (type_conversion_expression type: (slice_type element: (type_identifier)) operand: (interpreted_string_literal (interpreted_string_literal_content)))))))'),
        ("javascript", "let {a: b, c = 1} = d => e[0]", "(program (lexical_declaration (variable_declarator name: (object_pattern (pair_pattern key: (property_identifier) value: (identifier)) (object_assignment_pattern left: (shorthand_property_identifier_pattern) right: (number))) value: (arrow_function parameter: (identifier) body: (subscript_expression object: (identifier) index: (number))))))"),
        ("java", "class A { int x = (int) y; }", "(program (class_declaration name: (identifier) body: (class_body (field_declaration type: (integral_type) declarator: (variable_declarator name: (identifier) value: (cast_expression type: (integral_type) value: (identifier)))))))"),
        ("ruby", "a.b c: 1 do |x| x end", "(program (call receiver: (identifier) method: (identifier) arguments: (argument_list (pair key: (hash_key_symbol) value: (integer))) block: (do_block parameters: (block_parameters (identifier)) body: (body_statement (identifier)))))"),
        ("rust", "fn f() { a.b()?; }", "(source_file (function_item name: (identifier) parameters: (parameters) body: (block (expression_statement (try_expression (call_expression function: (field_expression value: (identifier) field: (field_identifier)) arguments: (arguments)))))))"),
        ("php", "<?php $a = b($c);", "(program (php_tag) (expression_statement (assignment_expression left: (variable_name (name)) right: (function_call_expression function: (name) arguments: (arguments (argument (variable_name (name))))))))"),
        ("dockerfile", "FROM a:1 AS b\nCOPY x /y\n", "(source_file (from_instruction (image_spec name: (image_name) tag: (image_tag)) as: (image_alias)) (copy_instruction (path) (path)))"),
    ],
)
def test_trees(lang, source, tree):
    assert repr(parsed(lang, source).nodes[0]) == tree


def test_other_languages_have_words_and_brackets(spark):
    f = parsed("kotlin", 'fun f(x: Int) { g("a // b") } // skipcq: c\n/* d */ h[1]')
    assert [f.text(n) for n in f.by_kind["comment"]] == ["// skipcq: c", "/* d */"] and [f.text(n) for n in f.by_kind["string"]] == ['"a // b"']
    assert captured(f, '(block (identifier) @x . (parenthesized (string)))') == ["g"] and captured(f, "(list (number) @x)") == ["1"]
    assert [n.kind for n in parsed("bash", "echo ${#a} # b\n)").nodes if n.kind in ("comment", "ERROR")] == ["comment", "ERROR"]
    c = load("{language: sql, name: s, message: 'no @w', pattern: '((identifier) @w (#match? @w \"^(?i)drop$\")) @s'}".replace("^(?i)", "(?i)^"))
    assert [(r.row, r.message) for r in check(files_of(spark, ("sql", "-- drop\nselect 1;\nDROP table x")), [c]).collect()] == [(2, "no DROP")]


def test_errors_are_local():
    f = parsed("python", "x = (\ny = 1\n")
    assert f.by_kind["ERROR"]
    f = parsed("javascript", "let a = ;\nf(1)\n")
    assert f.by_kind["ERROR"] and [f.text(n) for n in f.by_kind["call_expression"]] == ["f(1)"]


def test_node_table(spark):
    df = frontends.nodes(spark.createDataFrame([(1, "html", PAGE), (2, "html", None), (3, "markdown", "x"), (4, "html", "")], "file_id bigint, lang string, source string"))
    got = df.collect()
    assert {r.file_id for r in got} == {1, 4}
    own = [r for r in got if r.file_id == 1]
    data = PAGE.encode()
    assert all(r.text == data[r.start_byte : r.end_byte].decode() for r in own if r.text is not None)
    assert ("raw_text", 'var t="</p>";') in {(r.kind, r.text) for r in own} and any(r.kind == "erroneous_end_tag" for r in own)
    assert all(r.n_named == sum(k.parent_id == r.node_id and k.is_named for k in own) for r in own)
    assert df.filter("false").count() == 0


# patterns
def test_patterns():
    f = parsed("html", PAGE)
    n = lambda p: len(captured(f, p))
    assert n('(start_tag (tag_name) @t (#eq? @t "b")) @x') == 2
    assert n('(start_tag (tag_name) @x (#match? @x "^(b|a)$"))') == 3
    assert n('(start_tag (tag_name) @x (#not-match? @x "^(b|a)$"))') == 6
    assert n('(start_tag (tag_name) @x (#any-of? @x "ul" "li"))') == 3
    assert n("[(comment) @x (raw_text) @x]") == 2
    assert n('(start_tag (tag_name) @t (attribute)? @x (#eq? @t "a"))') == 1
    assert n('(element . (start_tag (tag_name) @t) . (element) @x (#eq? @t "ul"))') == 1
    assert n("(comment) @x (raw_text) @x") == 2
    assert n('(start_tag (tag_name) @x (#eq? @unbound "b"))') == 9  # a predicate on what isn't bound holds
    assert n('((element) @x (#match? @x "NOSUCHTEXT"))') == 0
    assert n('((element) @x (#match? @x "^<b>two</b>$"))') == 1
    assert n('((tag_name) @x (#not-eq? @x "b"))') + n('((tag_name) @x (#eq? @x "b"))') == n("(tag_name) @x")


def test_pattern_details():
    f = parsed("python", "f(a, 1, b)\ng(1)\nh()\n# c\n")
    assert captured(f, "(argument_list (identifier) @x .)") == ["b"]
    assert captured(f, "(argument_list . (identifier) @x)") == ["a"]
    assert captured(f, "(argument_list (integer) . (identifier) @x)") == ["b"]
    assert captured(f, "(argument_list (identifier) . (identifier) @x)") == []
    assert captured(f, "(argument_list (_)* (identifier) @x (_)*)") == ["a", "b"]
    assert captured(f, "(argument_list (identifier)* @x)") == ["a", "b"]
    assert captured(f, "(call function: (identifier) @x arguments: (argument_list (_)+ @y))") == ["f", "g"]
    assert captured(f, '(call function: (identifier) @a.b arguments: (argument_list . (_) @a_b) (#eq? @a_b "a")) @x') == ["f(a, 1, b)"]
    assert captured(f, "((expression_statement (call function: (identifier) @f)) (expression_statement (call function: (identifier) @g)) (#eq? @f \"f\")) @x") == ["f(a, 1, b)"] * 2
    assert captured(f, "(module (expression_statement (call function: (identifier) @x)) . (comment))") == ["h"]
    assert captured(f, '(call function: (identifier) @x arguments: (argument_list (identifier) @i (#match? @i "z")))') == []
    assert captured(f, "(call function: _ @x ; a remark\n)") == ["f", "g", "h"]
    g = parsed("javascript", "a == b; a != c")
    assert captured(g, '(binary_expression operator: "==" right: (identifier) @x)') == ["b"]
    assert captured(g, '[(binary_expression left: (identifier) @l right: (identifier) @x) (string)] (#eq? @l "z")') == []
    assert captured(parsed("javascript", "f(a, a); f(a, b)"), "((arguments (identifier) @l . (identifier) @x) (#eq? @l @x))") == ["a"]


@pytest.mark.parametrize("bad", ["(a", "", "a)", '((a) @x (#match? @x "("))', "()", "(a) (#eq?)"])
def test_bad_patterns(bad):
    with pytest.raises(PatternSyntaxError):
        parse(bad)


def test_pattern_table(spark):
    files = files_of(spark, ("python", "f(a)\ng(b)\n"), ("python", None), ("yaml", "f(a)"))
    got = tables.matches(files, "(call function: (identifier) @f arguments: (argument_list (identifier) @x)) @call", "x").collect()
    assert [(r.file_id, r.row, r.text, r.captures) for r in got] == [(0, 0, "a", ["call", "f(a)", "f", "f", "x", "a"]), (0, 1, "b", ["call", "g(b)", "f", "g", "x", "b"])]
    with pytest.raises(PatternSyntaxError):
        tables.matches(files, "(call) @c", "x")


def test_navigation():
    f = parsed("python", "def f(a, b=1):\n    return g(a)[0]\n")
    d = f.by_kind["function_definition"][0]
    params = by_field(d, "parameters")
    assert [k.kind for k in named(params)] == ["identifier", "default_parameter"] and f.text(nth_named(params, 1)) == "b=1" and nth_named(params, 2) is None
    assert first_of_kind(d, "block") is by_field(d, "body") and len(of_kind(params, "identifier")) == 1 and all_by_field(d, "parameters") == [params]
    assert previous(nth_named(params, 1)) is nth_named(params, 0) and previous(nth_named(params, 0)) is None
    assert first_where(params, lambda k: k.kind != "identifier").kind == "default_parameter"
    call = f.by_kind["call"][0]
    assert [a.kind for a in ancestors(call)] == ["subscript", "return_statement", "block", "function_definition", "module"] and list(descendants(d, "call")) == [call]
    seen, left = [], []
    visit(f.nodes[0], lambda n: seen.append(n.kind) or n.kind != "parameters", lambda n: left.append(n.kind))
    assert "default_parameter" not in seen and left[-1] == "module" and len(seen) == len(left)


# checkers
C = "{language: html, name: b, category: style, severity: info, message: 'tag @t', pattern: '(element (start_tag (tag_name) @t) (#eq? @t \"b\")) @b', filters: [{%s: '(element (start_tag (tag_name) @n (#eq? @n \"ul\")))'}]}"


def test_filters_and_message(spark):
    files = files_of(spark, ("html", PAGE), ("html", None), ("html", PAGE))
    assert [(r.file_id, r.row, r.message) for r in check(files, [load(C % "pattern-inside")]).collect()] == [(0, 0, "tag b"), (2, 0, "tag b")]
    assert [(r.row, r.message) for r in check(files, [load(C % "pattern-not-inside")]).collect()] == [(1, "tag b")] * 2
    assert check(files.filter("false"), [load(C % "pattern-inside")]).count() == 0 and check(files, []).count() == 0


def test_the_plan_of_a_check_has_no_exchange(spark):
    plan = check(files_of(spark, ("html", PAGE)), builtin())._jdf.queryExecution().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") >= 1


@pytest.mark.parametrize("bad", ["{language: html, name: a, message: b}", "{language: none, name: a, message: b, pattern: '(a)'}", "{language: html, message: b, pattern: '(a)'}", "{language: html, name: a, message: b, pattern: '(a)', patterns: ['(b)']}", "{language: html, name: a, message: b, pattern: '(a'}", "{language: html, name: a, message: b, pattern: '(a)', exclude: ['[z-a]']}"])
def test_bad_checkers(bad):
    with pytest.raises(ValueError):
        load(bad)


def test_unknown_values_load_but_are_not_valid():
    c = load("{language: PY, name: a, message: b, pattern: '(a) @a', category: none-such, severity: x, other: 1}")
    assert c.lang == "python" and not valid(c) and valid(load(C % "pattern-inside"))


def test_skip_comments_in_a_check():
    c = load("{language: py, name: no-eval, message: m, pattern: '((call function: (identifier) @f) (#eq? @f \"eval\")) @no-eval'}")
    source = "eval(1)  # skipcq\n\n# skipcq: no-eval, other\neval(2)\n# skipcq: other\neval(3)\n# SKIPCQ:other\n\neval(4)\n"
    assert [r[0] for r in issues_of(parsed("python", source), [c])] == [5, 8] and len(issues_of(parsed("python", source), [c], keep_skipped=True)) == 4


def test_globs():
    for glob, path, want in [("test/**", "test/a/b", True), ("*.py", "a/b.py", True), ("?.py", "ab.py", False), ("[!a].py", "b.py", True), ("{a,b}/*", "b/x", True), ("a.py", "axpy", False)]:
        assert bool(re.match(glob_regex(glob), path)) == want


def test_path_filters_of_checkers():
    c = load("{language: py, name: a, message: b, pattern: '(call) @a', include: ['src/**'], exclude: ['**_test.py']}")
    assert [c.wants(p) for p in ("src/a.py", "b.py", "src/a_test.py")] == [True, False, False]


# projects
@pytest.fixture
def root(tmp_path):
    base = tmp_path / "build" / "proj"  # the root's own ancestors aren't pruned
    for path, text in {"a.py": "eval(1)\nassert x\n", "src/b.py": "assert é\n", "node_modules/c.py": "assert 1\n", "src/vendor/d.py": "assert 2\n", "e.txt": "x", "Makefile": "x", "f.go": 'package a\nimport "unsafe"\n', "g_test.py": "assert 3\n", "src/__init__.py": "x = 1\n"}.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    (base / ".checkers").mkdir()
    (base / ".checkers/e.yml").write_text("{language: py, name: own-eval, category: bug-risk, severity: info, message: 'no @f', pattern: '((call function: (identifier) @f) (#eq? @f \"eval\")) @own-eval'}")
    (base / ".checkers/e.test.py").write_text("# <expect-error>\neval(1)\nx = 1\n# <expect error> again\neval(2)\n")
    return base


def test_trees_of_files(spark, root):
    assert {(r.path, r.lang) for r in list_tree(spark, str(root)).collect()} == {("a.py", "python"), ("src/b.py", "python"), ("f.go", "go"), ("g_test.py", "python"), ("src/__init__.py", "python"), (".checkers/e.yml", "yaml"), (".checkers/e.test.py", "python")}
    got = {r.path: r.source for r in read_tree(spark, str(root), F.col("lang") == "python").collect()}
    assert set(got) == {"a.py", "src/b.py", "g_test.py", "src/__init__.py", ".checkers/e.test.py"} and got["src/b.py"] == "assert é\n"
    assert read_tree(spark, str(root), F.lit(False)).count() == 0


def test_check_of_a_project(spark, root):
    found = lambda **kw: {(r.path, r.row, r.id) for r in project.check_project(spark, str(root), ignore=[".checkers/**"], **kw).issues.collect()}
    asserts = {("a.py", 1, "avoid-assert"), ("src/b.py", 0, "avoid-assert")}
    assert found() == asserts | {("a.py", 0, "own-eval"), ("f.go", 1, "go_unsafe_pkg")}
    assert found(which="local") == {("a.py", 0, "own-eval")} and found(which="builtin") == asserts | {("f.go", 1, "go_unsafe_pkg")}
    r = project.check_project(spark, str(root), project.Config(exclude=["src/**", "*.go"], categories=["security"], severities=["error"]), ignore=[".checkers/**"])
    assert {x.path for x in r.issues.collect()} == {"a.py"} and r.exit_status() == 0 and r.summary() == "Analyzed 2 files and found 2 issues."
    assert project.check_project(spark, str(root)).exit_status() == 1
    with pytest.raises(ValueError):
        project.select("none", None)


def test_config(tmp_path):
    p = tmp_path / "c.yml"
    assert project.load_config(p) == project.Config() == project.load_config(None)
    p.write_text("checkerDir: x\nexcludePatterns: ['a/**']\nfailWhen: {exitCode: 3, severityIn: [error], categoryIn: [style]}\nenabledCheckers: [a]\n")
    c = project.load_config(p)
    assert (c.checker_dir, c.exclude, c.exit_code, c.severities, c.categories, c.enabled) == ("x", ["a/**"], 3, ["error"], ["style"], ["a"])
    for bad in ("failWhen: {exitCode: -1}", "failWhen: {severityIn: [bad]}", "failWhen: {categoryIn: [bad]}", "excludePatterns: ['[z-a]']"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            project.load_config(p)


def test_loading_of_folders(root, tmp_path):
    assert [c.id for c in project.load_dir(root / ".checkers")] == ["own-eval"] and project.load_dir(tmp_path / "none") == []
    (root / ".checkers/f.yaml").write_text("{language: py, name: a}")
    with pytest.raises(ValueError, match="f.yaml"):
        project.load_dir(root / ".checkers")
    (tmp_path / "m.py").write_text("@checker('a', 'python', 'error')\ndef one(f):\n    pass\ndef two(f):\n    pass\n")
    (tmp_path / "n.py").write_text("# registry-exclude\n@checker('a')\ndef three(f):\n    pass\n")
    assert project.discover(tmp_path) == ["m.one"]


def test_tests_of_checkers(root):
    (t,) = project.test_dir(root / ".checkers")
    assert t.passed and t.expected == t.raised == [2, 5]
    (root / ".checkers/e.test.py").write_text("eval(1)\n")
    (t,) = project.test_dir(root / ".checkers")
    assert not t.passed and (t.expected, t.raised) == ([], [1])
    (root / ".checkers/e.test.py").unlink()
    assert not project.test_dir(root / ".checkers")[0].passed


def test_expectations_of_written_checkers():
    f = parsed("python", "# <expect-error> one: m\na = 1\nb = 2  # <expect-error>\n#<expect-error>\n")
    assert project.expected_messages(f, "python") == {2: ["one: m"], 3: [""]}
    assert project.expected_messages(parsed("javascript", "// <expect-error> x\nf()\n"), "javascript") == {2: ["x"]}


def test_tests_of_written_checkers(tmp_path):
    some = [c for c in builtin() if c.id in ("no-double-eq", "unused-import")]
    (tmp_path / "no-double-eq.test.js").write_text("// <expect-error>\na == b\nc == d // <expect-error> no-double-eq: Do not use '==' for comparison. Prefer '===' instead.\n")
    (tmp_path / "other.js").write_text("a == b\n")
    assert project.test_written(tmp_path, some) == {}
    (tmp_path / "unused-import.test.js").write_text("import a from 'b'\n// <expect-error> unused-import: other\nimport c from 'd'\n// <expect-error>\nf()\n")
    assert project.test_written(tmp_path, some) == {("unused-import.test.js", 1): ([], ['unused-import: unused import "a"']), ("unused-import.test.js", 3): (["unused-import: other"], ['unused-import: unused import "c"']), ("unused-import.test.js", 5): ([""], [])}


def test_prerequisites_and_shared_results():
    a = [c for c in builtin() if c.id == "no-double-eq"][0]
    b = Checker("b", "javascript", requires=[a], run=lambda f: iter(()))
    c = Checker("c", "javascript", requires=[b, a], run=lambda f: iter(()))
    assert [x.id for x in closure([c])] == ["no-double-eq", "b", "no-double-eq", "c"]
    f = parsed("javascript", "let a = 1\n")
    assert f.ask(Scopes) is f.ask(Scopes) and f.ask(DataFlow).scopes is f.ask(Scopes)


def test_scopes_of_another_language():
    class PythonScopes(Scopes):
        SCOPES, WHOLE = frozenset(["module", "function_definition"]), "module"

        def declared(self, n):
            if n.kind == "function_definition":
                yield Variable("function", self.f.text(by_field(n, "name")), n)
            elif n.kind == "assignment" and by_field(n, "left").kind == "identifier":
                yield Variable("variable", self.f.text(by_field(n, "left")), n)

        def refers(self, n):
            return n.kind == "identifier" and n.field not in ("left", "name", "attribute")

    s = PythonScopes(parsed("python", "def f():\n    x = y\n    return x\ny = 1\nf()\n"))
    assert {v.name: len(v.refs) for _, v in s.all()} == {"f": 1, "x": 1, "y": 1}


def test_reports_in_order_and_first_issues(spark, root, tmp_path):
    r = project.check_project(spark, str(root), ignore=[".checkers/**"])
    r.write(str(tmp_path / "out"), "text")
    lines = [x.value for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 4 and sorted(lines)[0].startswith("a.py:1:0:no eval")
    assert [x.path for x in ops.in_order(r.issues).collect()] == ["a.py", "a.py", "f.go", "src/b.py"]
    assert sorted((x.path, x.row) for x in ops.first_of_each(r.issues, "path").collect()) == [("a.py", 0), ("f.go", 1), ("src/b.py", 0)]


def test_language_columns(spark):
    from sylva.sources import languages as lang

    df = spark.createDataFrame([("PY", "a/b.py"), ("docker", "x.Dockerfile"), ("none", "Makefile")], "i string, p string")
    rows = df.select(lang.decode(F.col("i")).alias("l"), lang.detect(F.col("p")).alias("d")).collect()
    assert [(r.l, r.d) for r in rows] == [("python", "python"), ("dockerfile", "dockerfile"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("python",), ("dockerfile",), ("markdown",)], "l string").select(lang.test_extension(F.col("l"))).collect()] == [".py", ".Dockerfile", None]


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_changes(spark, root):
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    base = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    assert project.changed_files(str(root), base) == []
    (root / "a.py").write_text("assert y\n")
    git(root, "mv", "src/b.py", "src/z.py")
    git(root, "rm", "-q", "f.go")
    git(root, "commit", "-qam", "two")
    (root / "new.py").write_text("assert n\n")
    (root / "g_test.py").unlink()
    assert project.changed_files(str(root), base) == ["a.py", "new.py", "src/z.py"]
    assert {r.path for r in project.check_project(spark, str(root), since=base, which="builtin").issues.collect()} == {"a.py", "new.py", "src/z.py"}
    with pytest.raises(ValueError):
        project.changed_files(str(root), "")


def test_issues_as_json_and_back(spark, tmp_path):
    found = check(files_of(spark, ("html", PAGE)), [load(C % "pattern-inside")])
    lines = ops.report(found, "json")
    at = PAGE.encode().index(b"<b>two")
    assert lines.first().line == f'{{"category":"style","severity":"info","message":"tag b","range":{{"filename":"src/f0","start":{{"row":1,"column":{at}}},"end":{{"row":1,"column":{at + 10}}}}},"id":"b"}}'
    cols = ["path", "row", "col", "end_row", "end_col", "id", "message", "category", "severity"]
    assert ops.from_json(lines.union(spark.createDataFrame([("no json",)], "line string"))).select(cols).collect() == found.select(cols).collect()
    assert ops.report(found).first().line == f"src/f0:1:{at}:tag b"
    (tmp_path / "i.jsonl").write_text(lines.first().line + "\n")
    out = project.external(spark, ["sh", "-c", f"cat {tmp_path}/i.jsonl >&2; exit 1"])
    assert out.select(cols).collect() == found.select(cols).collect()
    with pytest.raises(RuntimeError):
        project.external(spark, ["sh", "-c", "exit 3"])


# scopes and data flow
def variables(source):
    s = Scopes(parsed("javascript", source))
    return {(v.name, v.kind): (len(v.refs), v.exported) for _, v in s.all()}


def test_scopes():
    got = variables("let x = 1\n{\n  let y = x\n}\nimport { e as r, g } from 'p'\nr('f')\nfunction f(r = x, n) { return n + n }\n")
    assert got[("x", "variable")] == (2, False) and got[("y", "variable")] == (0, False)
    assert got[("r", "import")] == (1, False) and got[("g", "import")] == (0, False) and got[("n", "parameter")] == (2, False) and got[("r", "parameter")] == (0, False)


def test_bindings_and_exports():
    got = variables("let [a, {b}] = q, {c, d: {e}} = q\nclass K { m() {} p = 1 }\nexport { a, b as z }\nexport const h = 1\nexport function i() {}\nexport default c\n")
    assert {n for n, _ in got} == {"a", "b", "c", "e", "K", "m", "p", "h", "i"} and {n for (n, _), (_, x) in got.items() if x} == {"a", "b", "h", "i", "c"}
    late = variables("use(w)\nvar w = 1\n")
    assert late[("w", "variable")] == (1, False)


def test_data_flow():
    f = parsed("javascript", "let a = 1\nconst b = a + ('x' + c), c = f(a, b)\nfunction g(p) { return p }\nconst h = () => 1\nlet t = `${c}`\nclass K { m() {} q = 1 }\n")
    d = DataFlow(f)
    assert {(v.name, s.variable.name) for v, flow in d.graph.items() for s in flow.sources} == {("b", "a"), ("c", "a"), ("c", "b"), ("t", "c")}
    assert set(d.functions) == {"g", "h"} and [p.name for p in d.functions["g"].parameters] == ["p"]
    ((methods, fields),) = d.classes.values()
    assert len(methods) == 1 and [v.name for v in fields] == ["q"]


# relational operators
def test_suppression(spark):
    found = spark.createDataFrame([(1, r, i) for r in range(4) for i in ("a", "b")], "file_id bigint, row int, id string")
    comments = spark.createDataFrame([(1, 0, "# SKIPCQ: a, c"), (1, 2, "# skipcq"), (1, 3, "# unrelated")], "file_id bigint, start_row int, text string")
    left = ops.suppress(found, ops.skip_comments(comments)).select("row", "id").collect()
    assert sorted(map(tuple, left)) == [(0, "b"), (1, "b")]


def test_difference(spark):
    make = lambda rows: spark.createDataFrame(rows, "file string, line int, message string")
    out = ops.difference(make([("f", 1, ""), ("f", 2, "m"), ("f", 3, "m")]), make([("f", 1, "any"), ("f", 2, "m"), ("f", 3, "n"), ("g", 9, "x")]))
    assert sorted((r.file, r.line) for r in out.collect()) == [("f", 3), ("g", 9)]


def test_lookup_of_repeated_checkers(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    info = spark.createDataFrame([("a", "style", "info"), ("a", "security", "error"), ("b", None, "info")], "id string, category string, severity string")
    assert sorted(map(tuple, ops.describe(found, info).collect())) == [("a", "style", "info"), ("b", "", "info"), ("c", "", "")]


def test_taint_is_forward_only(spark):
    rng = random.Random(3)
    data = [(f, p, f"v{rng.randrange(6)}", [f"v{rng.randrange(6)}"]) for f in range(20) for p in range(12)]
    got = {r.file_id: set(r.tainted) for r in ops.tainted(spark.createDataFrame(data, "file_id bigint, pos int, lhs string, rhs_names array<string>"), ["v0"]).collect()}
    for f in range(20):
        st = {"v0"}
        for _, _, lhs, rhs in sorted((r for r in data if r[0] == f), key=lambda r: r[1]):
            if st & set(rhs):
                st.add(lhs)
        assert got[f] == st


def test_driver_contract_has_no_orphans():
    from sylva import queries as own

    assert set(own.SQL) <= set(own.QUERIES) and "flagship" in own.QUERIES


# larger tables
def batches_of(rows, at_once=10_000):
    t = pa.table({"file_id": pa.array([r[0] for r in rows], pa.int64()), "lang": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())})
    return t.to_batches(max_chunksize=at_once)


PAIRS = pa.schema([("file_id", pa.int64()), ("word", pa.string())])


def test_equal_sources_are_read_once():
    read = []

    def words(lang, source):
        read.append(source)
        return [(x,) for x in source.split()]

    rows = [(i, "python" if i % 7 else "unknown", None if i % 5 == 0 else "a b" if i % 2 else "") for i in range(3000)]
    got = [tuple(r.values()) for b in frontends.per_source(batches_of(rows, 100), ["file_id", "lang", "source"], 1, PAIRS, frontends.source_key, words) for r in b.to_pylist()]
    assert got == [(i, x) for i, lang, s in rows if lang == "python" and s for x in s.split()]
    assert sorted(read) == ["", "a b"]


def test_what_is_kept_of_sources_is_bounded(monkeypatch):
    monkeypatch.setattr(frontends, "KEPT", 3000)
    read = []
    rows = [(i, "python", f"w{i % 100} x") for i in range(400)]
    got = [tuple(r.values()) for b in frontends.per_source(batches_of(rows), ["file_id", "lang", "source"], 1, PAIRS, frontends.source_key, lambda lang, s: read.append(s) or [(x,) for x in s.split()]) for r in b.to_pylist()]
    assert got == [(i, x) for i, _, s in rows for x in s.split()]
    assert len(read) == 400  # each was dropped before it came again


def test_tasks_of_spread_follow_the_table(spark, tmp_path, monkeypatch):
    from sylva import queries

    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(queries, "PART", 1 << 14)
    few, many = (queries.spread(spark.read.parquet(str(tmp_path / "t")).filter(f)).rdd.getNumPartitions() for f in ("false", "true"))
    assert few == spark.sparkContext.defaultParallelism < many


def test_equal_files_are_checked_once_and_reported_each(spark, tmp_path):
    log, own = tmp_path / "log", tmp_path / "counting_checker.py"
    own.write_text(f"def run(f):\n    open({str(log)!r}, 'a').write('x')\n    yield f.nodes[0], f.text(f.nodes[0])\n\ndef plain(f):\n    yield f.nodes[0], ''\n")
    spark.sparkContext.addPyFile(str(own))
    import counting_checker

    rules = [Checker("own", "python", run=counting_checker.run), Checker("some", "python", run=counting_checker.plain, include=["src/f1*"])]
    found = check(files_of(spark, *[("python", "a = 1\n")] * 30).coalesce(1), rules).collect()
    assert sorted((r.file_id, r.path, r.id) for r in found) == sorted([(i, f"src/f{i}", "own") for i in range(30)] + [(i, f"src/f{i}", "some") for i in range(30) if str(i)[0] == "1"])
    assert log.read_text() == "xx"  # with the one checker and with both


def test_spread_by_columns_brings_equal_values_side_by_side(spark):
    from sylva.queries import spread

    parts = spread(spark.range(4000).selectExpr("id", "id % 97 AS k"), "k").rdd.map(lambda r: r.k).glom().collect()
    seen = [k for p in parts for i, k in enumerate(p) if not i or p[i - 1] != k]
    assert sorted(seen) == list(range(97)) and sum(map(len, parts)) == 4000


def test_files_of_a_nation_dont_grow_with_its_customers(spark, tmp_path, monkeypatch):
    from sylva import queries

    spark.range(400).selectExpr("id AS c_custkey", "cast(id % 2 AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(900).selectExpr("id AS o_orderkey", "id % 600 AS o_custkey", "if(id % 3 = 0, 300000.0D, 1.0D) AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    used, files = {i % 600 for i in range(0, 900, 3)}, []
    monkeypatch.setattr(queries, "_KEYS", 50)
    monkeypatch.setattr(queries, "check", lambda f, c: files.append(f) or check(f, c))
    got = sorted(tuple(r) for r in queries.unused_declarations(spark, str(tmp_path)).collect())
    assert got == sorted((i % 2, f'unused import "c{i}"') for i in range(400) if i not in used)
    assert max(r.source.count("import") for r in files[0].collect()) == 25


def test_batches_are_bounded_in_rows_and_long_files_go_out_in_parts():
    long = "a " * 70_000
    rows = [(0, "python", long), *((i, "python", "x y z") for i in range(1, 30_000))]
    out = list(frontends.per_source(batches_of(rows), ["file_id", "lang", "source"], 1, PAIRS, frontends.source_key, lambda lang, s: ((x,) for x in s.split())))
    assert sum(b.num_rows for b in out) == 70_000 + 3 * 29_999 and max(b.num_rows for b in out) < frontends.ROWS + 3
