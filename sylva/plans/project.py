"""A project's check: configuration, checkers, files, changes, issues and the exit status; and the tests of checkers."""

from __future__ import annotations

import ast
import re
import subprocess
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.checkers import builtin
from sylva.functions.text import glob_regex, path_kept
from sylva.operators import issues as ops
from sylva.plans.checkers import CATEGORIES, SEVERITIES, Checker, check, issues_of, load
from sylva.plans.pattern import File
from sylva.sources.frontends import PARSERS, tree
from sylva.sources.languages import LANGUAGES, list_tree, read_tree


@dataclass
class Config:
    """enabled, disabled and targets are read and kept; checking doesn't use them."""

    checker_dir: str = ".checkers"
    enabled: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    exit_code: int = 1
    severities: list[str] = field(default_factory=lambda: ["critical"])
    categories: list[str] = field(default_factory=lambda: ["bug-risk"])


def load_config(path: str | Path | None) -> Config:
    """Defaults for a file that doesn't exist and for what it doesn't say."""
    if path is None or not Path(path).exists():
        return Config()
    y = yaml.safe_load(Path(path).read_text()) or {}
    fail = y.get("failWhen") or {}
    c = Config()
    c.checker_dir = y.get("checkerDir") or c.checker_dir
    c.enabled, c.disabled, c.targets, c.exclude = (list(y.get(k) or []) for k in ("enabledCheckers", "disabledCheckers", "targetDirs", "excludePatterns"))
    c.exit_code = fail.get("exitCode") if fail.get("exitCode") is not None else c.exit_code
    c.severities = list(fail.get("severityIn") or c.severities)
    c.categories = list(fail.get("categoryIn") or c.categories)
    if c.exit_code < 0:
        raise ValueError("exitCode must be a non-negative integer")
    for what, given, known in (("severity", c.severities, SEVERITIES), ("category", c.categories, CATEGORIES)):
        for x in given:
            if x not in known:
                raise ValueError(f"invalid {what}: {x}")
    for g in c.exclude:
        try:
            re.compile(glob_regex(g))
        except re.error as e:
            raise ValueError(f"malformed glob {g!r}") from e
    return c


def load_dir(folder: str | Path) -> list[Checker]:
    """The YAML checkers below a folder, in order of their paths; the first that can't be loaded is an error. No folder, no checkers."""
    out = []
    for p in sorted(Path(folder).rglob("*")) if Path(folder).is_dir() else []:
        if p.suffix in (".yml", ".yaml") and p.is_file() and not p.is_symlink() and not p.name.startswith("."):
            try:
                out.append(load(p.read_text()))
            except ValueError as e:
                raise ValueError(f"invalid checker {p.name!r}: {e}") from e
    return out


def discover(folder: str | Path) -> list[str]:
    """module.function of the functions in a folder's Python files that are decorated as checkers. A file whose
    first comment block says registry-exclude is left out."""
    out = []
    for p in sorted(Path(folder).glob("*.py")):
        text = p.read_text()
        head = re.match(r"(?:\s*#[^\n]*\n)+", text)
        if head and "registry-exclude" in head[0]:
            continue
        for n in ast.parse(text).body:
            calls = [d.func for d in getattr(n, "decorator_list", []) if isinstance(d, ast.Call)]
            if any(getattr(c, "id", getattr(c, "attr", "")) == "checker" for c in calls):
                out.append(f"{p.stem}.{n.name}")
    return out


def select(which: str, checker_dir: str | Path | None) -> list[Checker]:
    """builtin, local or all; all appends the local ones."""
    if which not in ("builtin", "local", "all"):
        raise ValueError(f"checkers are builtin, local or all, not {which!r}")
    out = builtin() if which != "local" else []
    return out + (load_dir(checker_dir) if which != "builtin" and checker_dir else [])


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def changed_files(root: str, base: str) -> list[str]:
    """Paths, relative to root, that differ from the commit `base`: added and modified ones of HEAD and of the working
    tree, untracked ones too, without deleted ones. Of a rename the new path counts."""
    if not base:
        raise ValueError("a commit to compare with is required")
    parts = _git(root, "diff", "--no-renames", "--name-status", "-z", base, "HEAD").split("\0")
    changed = {p for state, p in zip(parts[::2], parts[1::2], strict=False) if state != "D"}
    for x in _git(root, "status", "--porcelain", "--no-renames", "-uall", "-z").split("\0"):
        if x:
            changed.discard(x[3:])
            if "D" not in x[:2]:
                changed.add(x[3:])
    return sorted(changed)


@dataclass
class Result:
    issues: DataFrame
    files: DataFrame
    config: Config

    def count_files(self) -> int:
        return self.files.count()

    def exit_status(self) -> int:
        return ops.exit_status(self.issues, self.config.severities, self.config.categories, self.config.exit_code).first()[0]

    def write(self, path: str, form: str = "text") -> None:
        """The report, in order, an issue a line, in files below path."""
        ops.report(ops.in_order(self.issues), form).write.text(path)

    def summary(self) -> str:
        n = self.count_files()
        return f"Analyzed {n} files and found {self.issues.count()} issues." if n else "No files to analyze"


def external(spark: SparkSession, command: Sequence[str], cwd: str | None = None) -> DataFrame:
    """Issues that another program writes as JSON lines to its standard error; it ends with 1 if there are any."""
    done = subprocess.run(list(command), capture_output=True, text=True, cwd=cwd)
    if done.returncode not in (0, 1):
        raise RuntimeError(f"{command[0]} failed with {done.returncode}: {done.stderr[-500:]}")
    lines = [(x,) for x in done.stderr.splitlines() if x.strip()]
    return ops.from_json(spark.createDataFrame(lines, "line string"))


def check_project(spark: SparkSession, root: str, config: Config | None = None, which: str = "all", ignore: Sequence[str] = (), since: str | None = None, command: Sequence[str] | None = None) -> Result:
    """One plan: files are listed, pruned, read, parsed once and checked by all checkers of their language. `ignore` adds to
    the globs that leave paths out; `since` leaves only files that changed since a commit; `command` adds another program's issues."""
    config = config or Config()
    kept: Column = path_kept(F.col("path"), exclude=[*config.exclude, *ignore])
    if since is not None:
        kept = kept & F.col("path").isin(*changed_files(root, since)) if changed_files(root, since) else F.lit(False)
    checkers = select(which, Path(root, config.checker_dir))
    found = check(read_tree(spark, root, kept & F.col("lang").isin(*PARSERS)), checkers).drop("file_id", "lang")
    if command:
        found = found.unionByName(external(spark, command, root))
    return Result(found, list_tree(spark, root).filter(kept), config)


# tests of checkers
def test_path(path: str, lang: str) -> str:
    """Where a YAML checker's test file is."""
    ext = ".Dockerfile" if lang == "dockerfile" else LANGUAGES[lang][1][0]
    return re.sub(r"\.ya?ml$", "", path) + ".test" + ext


def expected_lines(source: str) -> list[int]:
    """Of a YAML checker's test file: the lines after those that expect an error."""
    return [i + 2 for i, x in enumerate(source.lower().split("\n")) if "<expect-error>" in x or "<expect error>" in x]


def expected_messages(f: File, lang: str) -> dict[int, list[str]]:
    """Of a written checker's test file: line -> messages, by comments before a line or behind what stands on theirs."""
    mark = re.compile(rf"^{LANGUAGES[lang][2]}\s+<expect-error>\s*(?P<message>.*)$")
    out: dict[int, list[str]] = {}
    for n in f.by_kind["comment"]:
        m = mark.search(f.text(n))
        if m:
            row = f.src.count("\n", 0, n.start)
            before = n.up.kids[n.place - 1] if n.place else None
            same = before is not None and f.src.count("\n", 0, before.end) == row
            out.setdefault(f.src.count("\n", 0, before.start) + 1 if same else row + 2, []).append(m["message"])
    return out


def expected_of(files: DataFrame) -> DataFrame:
    """(file, line, message): what test files (path, source) of YAML checkers expect, as a plan."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.lower("source"), "\n", -1)).alias("i", "text"))
    return lines.filter(F.col("text").contains("<expect-error>") | F.col("text").contains("<expect error>")).select("file", (F.col("i") + 2).alias("line"), F.lit("").alias("message"))


@dataclass
class Tested:
    checker: str
    test: str | None
    expected: list[int]
    raised: list[int]

    @property
    def passed(self) -> bool:
        return self.test is not None and self.expected == self.raised


def test_dir(folder: str | Path) -> list[Tested]:
    """Runs a folder's YAML checkers on their test files; path filters don't hold there. One without a test file doesn't pass."""
    out = []
    for p in sorted(Path(folder).rglob("*.y*ml")):
        c = load(p.read_text())
        c.include, c.exclude = [], []
        test = Path(test_path(str(p), c.lang))
        if not test.exists():
            out.append(Tested(c.id, None, [], []))
            continue
        data = test.read_bytes()
        got = tree(c.lang, data)
        raised = sorted(r[0] + 1 for r in issues_of(File(*got), [c])) if got else []
        out.append(Tested(c.id, test.name, sorted(expected_lines(data.decode(errors="replace"))), raised))
    return out


def is_test_of(path: str, checkers: Sequence[Checker]) -> bool:
    """Whether a file is named as the test of one of the checkers."""
    return any(path.endswith(test_path(c.id, c.lang)) for c in checkers)


def test_written(folder: str | Path, checkers: Sequence[Checker]) -> dict[tuple[str, int], tuple[list[str], list[str]]]:
    """(file, line) -> expected and raised messages, sorted, where they differ: all checkers on the test files of any of them.
    A raised message is "id: message"; an expected one that is empty stands for any."""
    out = {}
    for p in sorted(Path(folder).rglob("*")):
        if not (p.is_file() and is_test_of(p.name, checkers)):
            continue
        lang = next(c.lang for c in checkers if is_test_of(p.name, [c]))
        f = File(*tree(lang, p.read_bytes()))
        want = expected_messages(f, lang)
        got: dict[int, list[str]] = {}
        for row, _, _, _, id_, message, *_ in issues_of(f, [c for c in checkers if c.lang == lang], str(p)):
            got.setdefault(row + 1, []).append(f"{id_}: {message}")
        for line in sorted({*want, *got}):
            a, b = sorted(want.get(line, [])), sorted(got.get(line, []))
            if len(a) != len(b) or any(x not in ("", y) for x, y in zip(a, b, strict=True)):
                out[p.name, line] = a, b
    return out
