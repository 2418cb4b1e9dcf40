"""Fact extraction from source text: one file in, many fact rows out.

There is no syntax-tree library here, so all languages but Python are read by line-oriented scanners
with brace tracking; Python uses the standard `ast` module and is exact. Every scanner is a pure
function (path, text) -> rows, run by `facts` over Arrow batches; a file that a scanner can't read
becomes one `error` row and never fails the job.

Rows: (path, language, fact, name, kind, scope, visibility, line_start, line_end, target, confidence, detail).
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

COLUMNS = ["path", "language", "fact", "name", "kind", "scope", "visibility", "line_start", "line_end", "target", "confidence", "detail"]
SCHEMA = "path string, language string, fact string, name string, kind string, scope string, visibility string, line_start long, line_end long, target string, confidence double, detail string"

#: Facts from which on a batch is handed over.
BATCH = 1000

#: Languages by file suffix.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cj": "cangjie", "ets": "arkts", "sh": "shell", "bash": "shell", "md": "markdown"}

#: Enum constructors that Rust code calls like functions.
ENUM_CONSTRUCTORS = {"Some", "None", "Ok", "Err"}

#: Words that are followed by a parenthesis without being calls.
NOT_CALLS = {"if", "while", "for", "match", "switch", "return", "fn", "func", "function", "catch", "sizeof", "loop", "in", "as", "let", "const", "await", "typeof", "new", "super", "import", "constructor", "else", "do", "defined", "alignof", "decltype", "static_assert", "pub", "where", "move", "impl", "export", "default"}


def row(fact: str, name: str | None = None, kind: str | None = None, scope: str | None = None, visibility: str | None = None, start: int | None = None, end: int | None = None, target: str | None = None, confidence: float | None = None, detail: str | None = None) -> tuple:
    return fact, name, kind, scope, visibility, start, end if end is not None else start, target, confidence, detail


def blank_literals(line: str, comment: str = "//") -> str:
    """The line with string contents and a trailing comment blanked, so braces and calls are code's."""
    line = re.sub(r'"(?:\\.|[^"\\])*"', lambda m: '"' + " " * (len(m[0]) - 2) + '"', line)
    line = re.sub(r"'(?:\\.|[^'\\])'", "' '", line)
    at = line.find(comment)
    return line[:at] if at >= 0 else line


def block_end(lines: list[str], at: int) -> int:
    """Index of the line that closes the block opened at or after line `at`; `at` for items that end in ';' first."""
    depth, opened = 0, False
    for k in range(at, len(lines)):
        for ch in lines[k]:
            if ch == "{":
                depth, opened = depth + 1, True
            elif ch == "}":
                depth -= 1
            elif ch == ";" and not opened and depth == 0:
                return k
        if opened and depth <= 0:
            return k
    return len(lines) - 1 if opened else at


def expand_use(text: str) -> list[tuple[str, str | None]]:
    """`a::{b as c, d::{e, *}}` as (path, alias) rows."""
    text = text.strip()
    if "{" not in text:
        path, _, alias = text.partition(" as ")
        return [(path.strip(), alias.strip() or None)]
    head, _, rest = text.partition("{")
    inner, depth, parts, now = rest[: rest.rfind("}")], 0, [], ""
    for ch in inner:
        if ch == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            depth += (ch == "{") - (ch == "}")
            now += ch
    parts.append(now)
    out = []
    for p in filter(None, (x.strip() for x in parts)):
        for path, alias in expand_use(p):
            out.append((head.strip().removesuffix("::") if path == "self" else head.strip() + path, alias))
    return out


_RUST_ITEM = re.compile(r"^\s*(?:#\[[^\]]*\]\s*)*(?P<vis>pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+(?=fn|unsafe|async)|extern\s+\"[^\"]*\"\s+)*(?P<kw>fn|struct|enum|trait|mod|type|const|static|union|macro_rules!|impl)\b(?P<rest>.*)")
_CALL = re.compile(r"(?P<dot>\.)?\b(?P<name>[A-Za-z_][\w]*(?:(?:::|\.)[A-Za-z_]\w*)*)(?P<turbo>::<[^()]*>)?\s*(?P<bang>!)?\(")
_RUST_KINDS = {"fn": "function", "mod": "module", "type": "type-alias", "macro_rules!": "macro-definition", "impl": "impl-block", "union": "struct"}


def _rust_visibility(vis: str | None) -> str:
    v = (vis or "").strip()
    return {"": "private", "pub": "public", "pub(crate)": "pub-crate", "pub(super)": "pub-super"}.get(v, "pub-restricted" if v.startswith("pub(") else "private")


def _until(lines: list[str], at: int, end: int, mark: str) -> str:
    """The lines from `at` on, joined, before the first `mark`."""
    out = []
    for line in lines[at : end + 1]:
        head, found, _ = line.partition(mark)
        out.append(head)
        if found:
            break
    return " ".join(out)


def _body_of(lines: list[str], at: int, end: int) -> tuple[int, int]:
    """(line, column) where the body of the function whose head starts on line `at` opens; after `end` where there is none."""
    depth = 0
    for k in range(at, end + 1):
        for col, ch in enumerate(lines[k]):
            depth += (ch in "([") - (ch in ")]")
            if depth == 0 and ch == "{":
                return k, col + 1
            if depth == 0 and ch == ";":
                return end + 1, 0
    return end + 1, 0


def _after_generics(text: str) -> str:
    """The text after a leading `<...>`, whose arrows don't close it."""
    depth = 0
    for k, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">" and text[k - 1] not in "-=")
        if depth <= 0:
            return text[k + 1 :].lstrip() if ch == ">" else text
    return text


def _takes_self(lines: list[str], at: int, end: int, name: str) -> bool:
    """Whether the first parameter of the function `name`, after its generics, is self."""
    depth, before, text = 0, "", None
    for line in lines[at : end + 1]:
        if text is None:
            found = re.search(rf"\bfn\s+{name}\b", line)
            if not found:
                continue
            text, line = "", line[found.end() :]
        for ch in line + " ":
            if text:
                text += ch
                if ch in ",):" and text[1:].strip(" ,:)"):
                    return bool(re.match(r"\(\s*(&\s*('\w+\s+)?)?(mut\s+)?self\s*[,):]", text))
                if ch == ")":
                    return False
            elif ch == "(" and depth == 0:
                text = ch
            elif ch == "<":
                depth += 1
            elif ch == ">" and before not in "-=":
                depth -= 1
            before = ch
    return False


def rust(path: str, text: str) -> Iterator[tuple]:
    raw = text.split("\n")
    lines = [blank_literals(x) for x in raw]
    stack: list[tuple[str, str, int]] = []  # (kind, name, last line)
    body: tuple[int, int] | None = None  # where the last function head met ends
    k = 0
    while k < len(lines):
        stack = [s for s in stack if s[2] >= k]
        mods = "::".join(n for t, n, _ in stack if t == "mod")
        owner = next((s for s in reversed(stack) if s[0] in ("impl", "trait")), None)
        inside = any(s[0] == "fn" for s in stack)
        if m := re.match(r"^\s*(pub(?:\([^)]*\))?\s+)?use\s+(.*)", lines[k]):
            tree, e = m[2], k
            while ";" not in tree and e + 1 < len(lines):
                e += 1
                tree += " " + lines[e].strip()
            for target, alias in expand_use(tree.split(";")[0]):
                first = target.split("::")[0]
                kind = first if first in ("crate", "self", "super") else "external"
                yield row("import", alias or target.split("::")[-1], kind, mods, _rust_visibility(m[1]), k + 1, e + 1, target, detail="reexport" if m[1] else "alias" if alias else None)
            k = e + 1
            continue
        if m := _RUST_ITEM.match(lines[k]):
            kw, rest, end = m["kw"], m["rest"], block_end(lines, k)
            if kw == "impl":
                sig = _after_generics(re.sub(r"^.*?\bimpl\b\s*", "", _until(lines, k, end, "{")))
                trait, _, typ = sig.partition(" for ")
                name = re.split(r"[<\s{]", (typ or trait).strip())[0]
                yield row("symbol", name, "impl-block", mods, "private", k + 1, end + 1, target=name, detail=re.split(r"[<\s{]", trait.strip())[0] if typ else None)
                stack.append(("impl", name, end))
            elif n := re.match(r"\s*([A-Za-z_]\w*)", rest):
                name, kind = n[1], _RUST_KINDS.get(kw, kw)
                if kw == "fn":
                    body = _body_of(lines, k, end)
                if kw == "fn" and owner:
                    kind = "method" if _takes_self(lines, k, end, name) else "associated-function"
                if not (inside and kw in ("const", "static", "type")):
                    yield row("symbol", name, kind, "::".join(filter(None, [mods, owner[1] if owner else ""])), _rust_visibility(m["vis"]), k + 1, end + 1)
                if kw == "enum":
                    for j in range(k + 1, end):
                        if v := re.match(r"^\s{1,8}([A-Z]\w*)\s*(?:[({,=]|$)", lines[j]):
                            yield row("symbol", v[1], "enum-variant", name, "public", j + 1)
                if "{" in "".join(lines[k : end + 1]):
                    stack.append(("mod" if kw == "mod" else "fn" if kw == "fn" else "trait" if kw == "trait" else kw, name, end))
        code = lines[k]
        if body:  # no calls in heads: bounds and patterns look like some
            code = "" if k < body[0] else code[body[1] :] if k == body[0] else code
            body = body if k < body[0] else None
        for c in _CALL.finditer(code):
            name = c["name"]
            last = re.split(r"::|\.", name)[-1]
            if c["bang"] or last in NOT_CALLS - {"new"}:
                continue
            if c["dot"] or "." in name:
                yield row("call", last, "method", start=k + 1, target=last, detail=name)
            elif name in ENUM_CONSTRUCTORS:
                yield row("call", name, "enum-constructor", start=k + 1, target=name, confidence=0.80)
            else:
                seg = name.split("::")
                kind = "free-function" if len(seg) == 1 else {"crate": "qualified-path", "self": "self-path", "super": "super-path"}.get(seg[0], "associated-function" if seg[-2][:1].isupper() else "qualified-path")
                yield row("call", last, kind, start=k + 1, target=name)
        k += 1


def python(path: str, text: str) -> Iterator[tuple]:
    tree = ast.parse(text)

    def walk(node: ast.AST, scope: str, in_class: bool) -> Iterator[tuple]:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                cls = isinstance(x, ast.ClassDef)
                kind = "class" if cls else "method" if in_class else "function"
                yield row("symbol", x.name, kind, scope, "private" if x.name.startswith("_") else "public", x.lineno, x.end_lineno)
                yield from walk(x, f"{scope}.{x.name}".strip("."), cls)
                continue
            if isinstance(x, ast.Import):
                for a in x.names:
                    yield row("import", a.asname or a.name, "import", scope, start=x.lineno, target=a.name, confidence=0.85)
            elif isinstance(x, ast.ImportFrom):
                for a in x.names:
                    conf = 0.20 if a.name == "*" else 0.70 if x.level else 0.85
                    yield row("import", a.asname or a.name, "star" if a.name == "*" else "relative" if x.level else "from", scope, start=x.lineno, target="." * x.level + (x.module or ""), confidence=conf, detail=a.name)
            elif isinstance(x, ast.Call):
                full = ast.unparse(x.func)
                simple = isinstance(x.func, ast.Name)
                own = full.startswith(("self.", "cls."))
                conf = 0.90 if simple else 0.80 if own else 0.60 if re.fullmatch(r"[\w.]+", full) else 0.45
                yield row("call", full.split(".")[-1], "name" if simple else "self" if own else "attribute" if conf == 0.60 else "dynamic", scope, start=x.lineno, target=full, confidence=conf)
            elif isinstance(x, ast.Assign) and not scope:
                for name in (n.id for n in x.targets if isinstance(n, ast.Name)):
                    yield row("symbol", name, "constant" if name.isupper() else "variable", scope, "private" if name.startswith("_") else "public", x.lineno, x.end_lineno)
            yield from walk(x, scope, in_class and not isinstance(x, ast.stmt))

    yield from walk(tree, "", False)


_SCRIPT_ITEM = re.compile(r"^\s*(?P<vis>export\s+(?:default\s+)?)?(?:declare\s+|abstract\s+|async\s+)*(?P<kw>function\*?|class|interface|type|enum|namespace|struct|const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)(?P<rest>.*)")
_SCRIPT_METHOD = re.compile(r"^\s*(?:(?P<vis>public|private|protected)\s+)?(?:static\s+|async\s+|readonly\s+|get\s+|set\s+)*(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;]*)?\{")


def script(path: str, text: str) -> Iterator[tuple]:
    lines = [blank_literals(x) if not re.match(r"\s*(import|export)\b", x) and "require(" not in x else x for x in text.split("\n")]
    classes: list[tuple[str, int, str]] = []
    for k, line in enumerate(lines):
        classes = [c for c in classes if c[1] >= k]
        if m := re.match(r"^\s*import\s+(?:type\s+)?(?:(.*?)\s+from\s+)?['\"]([^'\"]+)['\"]", line):
            names = re.findall(r"[\w$*]+(?:\s+as\s+[\w$]+)?", m[1] or "") or [""]
            for n in names:
                orig, _, alias = n.partition(" as ")
                yield row("import", (alias or orig).strip() or None, "side-effect" if not n else "esm", start=k + 1, target=m[2], detail=orig.strip() or None)
        elif m := re.match(r"^\s*export\s+(.*?)\s+from\s+['\"]([^'\"]+)['\"]", line):
            yield row("import", m[1].strip("{} "), "reexport", start=k + 1, target=m[2])
        for m in re.finditer(r"(?:const|let|var)\s+([\w${}, ]+?)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", line):
            yield row("import", m[1].strip("{} "), "require", start=k + 1, target=m[2])
        for m in re.finditer(r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)", line):
            yield row("import", None, "dynamic", start=k + 1, target=m[1])
        code, method = line, None
        if m := _SCRIPT_ITEM.match(line):
            kw = m["kw"].rstrip("*")
            arrow = kw in ("const", "let", "var") and re.search(r"=>|=\s*(async\s+)?function\b", m["rest"])
            if kw not in ("const", "let", "var") or arrow or m["vis"]:
                kind = "function" if arrow else {"const": "variable", "let": "variable", "var": "variable", "type": "type-alias"}.get(kw, kw)
                end = block_end(lines, k)
                yield row("symbol", m["name"], kind, classes[-1][0] if classes else "", "public" if m["vis"] else "private", k + 1, end + 1)
                if kw in ("class", "struct", "interface"):
                    classes.append((m["name"], end, kw))
                    code = line.partition("{")[2]
                    method = _SCRIPT_METHOD.match(code) if kw != "interface" else None
            if kw == "function":
                code = re.sub(r"^.*?\bfunction\*?\s+[\w$]+\s*(?:<[^>]*>)?\s*\([^)]*\)", "", line)
        elif classes and not _is_view(line, classes):
            method = _SCRIPT_METHOD.match(line)
        if method and method["name"] not in NOT_CALLS:
            yield row("symbol", method["name"], "method", classes[-1][0], "private" if method["vis"] in ("private", "protected") or method["name"].startswith("#") else "public", k + 1, block_end(lines, k) + 1)
            code = code[method.end() :]
        if re.match(r"^\s*(import|export)\b.*['\"]", line) or classes and classes[-1][2] == "interface":
            continue
        for m in re.finditer(r"(\bnew\s+)?\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*(?:<[\w, ]*>)?\(", re.sub(r"\bfunction\*?\s+\w+", "", code)):
            last = m[2].split(".")[-1]
            if last not in NOT_CALLS and last != "require":
                view = classes and classes[-1][2] == "struct" and last[:1].isupper() and not m[1] and "." not in m[2]
                yield row("call", last, "view" if view else "new-expression" if m[1] else "member-access" if "." in m[2] else "call", start=k + 1, target=m[2])


def _is_view(line: str, classes: list[tuple[str, int, str]]) -> bool:
    """`Column() {` in a component's struct: a view with children, not a method."""
    return classes[-1][2] == "struct" and bool(re.match(r"^\s*[A-Z][\w$]*\s*\(", line))


def arkts(path: str, text: str) -> Iterator[tuple]:
    yield from script(path, text)
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if re.match(r"^\s*@(Component|ComponentV2|Entry|CustomDialog)\b", line):
            for j in range(k, min(k + 5, len(lines))):
                if m := re.search(r"\bstruct\s+(\w+)", lines[j]):
                    yield row("symbol", m[1], "component", start=j + 1, end=block_end([blank_literals(x) for x in lines], j) + 1, detail=line.strip())
                    break
        for m in re.finditer(r"@(State|Prop|Link|Provide|Consume|ObjectLink|StorageLink|StorageProp|Local|Param)\b(?:\([^)]*\))?\s*(?:private\s+|public\s+)?(\w+)", line):
            yield row("symbol", m[2], "state", start=k + 1, detail=m[1])


_C_FUNCTION = re.compile(r"^(?!\s*(?:(?:else|return|if|for|while|switch|typedef)\b|#))\s*(?P<ret>[A-Za-z_][\w\s*&:<>,~]*?[\s*&])?(?P<name>~?[A-Za-z_]\w*(?:::~?[A-Za-z_]\w*)*)\s*\((?P<args>[^;{}]*)\)\s*(?:const\s*|noexcept\s*|override\s*)*(?P<end>[{;]?)\s*$")


def _c_like(path: str, text: str, cpp: bool) -> Iterator[tuple]:
    raw = text.split("\n")
    lines = [blank_literals(x) for x in raw]
    scopes: list[tuple[str, str, int]] = []
    for k, line in enumerate(lines):
        scopes = [s for s in scopes if s[2] >= k]
        scope = "::".join(s[1] for s in scopes if s[0] != "function")
        if m := re.match(r'^\s*#\s*include\s*(["<])([^">]+)[">]', raw[k]):
            yield row("import", m[2].split("/")[-1], "quoted" if m[1] == '"' else "angle", start=k + 1, target=m[2])
            continue
        if m := re.match(r"^\s*#\s*define\s+(\w+)", line):
            yield row("symbol", m[1], "macro", scope, "public", k + 1)
            continue
        in_function, code = any(s[0] == "function" for s in scopes), line
        head = line[: line.index("{") + 1] if "{" in line else line  # a body may follow on the same line
        if m := re.match(r"^\s*(?:typedef\s+)?(struct|union|enum(?:\s+class)?|class|namespace)\s+(\w+)[^;()]*(\{|$)", line):
            end = block_end(lines, k)
            kind = m[1].split()[0]
            yield row("symbol", m[2], kind, scope, "public", k + 1, end + 1)
            if cpp and end > k:
                scopes.append((kind, m[2], end))
            continue
        if m := re.match(r"^\s*typedef\b.*?(\w+)\s*;", line):
            yield row("symbol", m[1], "typedef", scope, "public", k + 1)
            continue
        if not in_function and (m := _C_FUNCTION.match(head)) and (m["ret"] or cpp and scopes) and m["name"] not in NOT_CALLS:
            opened = m["end"] == "{" or (not m["end"] and k + 1 < len(lines) and lines[k + 1].strip().startswith("{"))
            if opened:
                end = block_end(lines, k)
                inside = scopes and scopes[-1][0] in ("class", "struct")
                yield row("symbol", m["name"].split("::")[-1], "method" if inside or "::" in m["name"] else "function", "::".join(filter(None, [scope, *m["name"].split("::")[:-1]])), "private" if "static " in (m["ret"] or "") else "public", k + 1, end + 1)
                scopes.append(("function", m["name"], end))
                in_function, code = True, line[len(head) :] if m["end"] == "{" else ""
            elif m["end"] == ";" and m["ret"]:
                yield row("symbol", m["name"], "declaration", scope, "public", k + 1)
        if in_function:
            for c in re.finditer(r"(this->|[\w\])]+(?:\.|->))?\b([A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)\s*(<[\w:, *&]*>)?\s*\(", code):
                if c[2] in NOT_CALLS:
                    continue
                kind = "this" if c[1] == "this->" else "receiver" if c[1] else "template" if c[3] else "qualified" if "::" in c[2] else "plain"
                yield row("call", c[2].split("::")[-1], kind, scope, start=k + 1, target=c[2], confidence=0.40 if kind == "template" else None)


def c(path: str, text: str) -> Iterator[tuple]:
    return _c_like(path, text, False)


def cpp(path: str, text: str) -> Iterator[tuple]:
    return _c_like(path, text, True)


def cangjie(path: str, text: str) -> Iterator[tuple]:
    lines = [blank_literals(x) for x in text.split("\n")]
    owners: list[tuple[str, int]] = []
    for k, line in enumerate(lines):
        owners = [o for o in owners if o[1] >= k]
        if m := re.match(r"^\s*package\s+([\w.]+)", line):
            yield row("package", m[1], "package", start=k + 1)
        elif m := re.match(r"^\s*(public\s+)?import\s+([\w.]+?)(?:\.(\*|\{[^}]*\}))?(?:\s+as\s+(\w+))?\s*;?\s*$", line):
            for n in ["*"] if m[3] == "*" else re.findall(r"\w+", m[3] or "") or [m[2].split(".")[-1]]:
                kind = "wildcard" if n == "*" else "alias" if m[4] else "explicit"
                yield row("import", m[4] or n, kind, start=k + 1, target=m[2], confidence={"wildcard": 0.70, "alias": 0.80, "explicit": 0.85}[kind])
        elif m := re.match(r"^\s*((?:public|private|protected|internal|open|static|override|mut|sealed|abstract|unsafe|operator|const)\s+)*(func|class|struct|interface|enum|extend|type|let|var|init|main|macro)\b\s*(\w+)?", line):
            kw, end = m[2], block_end(lines, k)
            if not (kw in ("let", "var") and owners and owners[-1][0].endswith("()")):
                name = m[3] or kw
                vis = next((v for v in ("public", "private", "protected", "internal") if re.search(rf"\b{v}\b", line.split(kw)[0])), "internal")
                yield row("symbol", name, {"func": "method" if owners else "function", "let": "variable", "var": "variable"}.get(kw, kw), owners[-1][0] if owners else "", vis, k + 1, end + 1)
                if end > k:
                    owners.append((name + "()" if kw in ("func", "init", "main") else name, end))
        for m in re.finditer(r"(?<!func )\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\(", re.sub(r"^.*?\b(func\s+\w+|init|main)\s*(<[^>]*>)?\s*\([^)]*\)", "", line)):
            if m[1].split(".")[-1] not in NOT_CALLS | {"init", "main"}:
                yield row("call", m[1].split(".")[-1], "call", start=k + 1, target=m[1], confidence=0.80)


_SHELL_WORDS = {"if", "then", "else", "elif", "fi", "for", "do", "done", "while", "until", "case", "esac", "in", "function", "select", "time", "{", "}", "!", "[[", "[", "]]", "]"}


def shell(path: str, text: str) -> Iterator[tuple]:
    lines = text.split("\n")
    scope, depth = "", 0
    for k, raw in enumerate(lines):
        line = re.sub(r"(^|\s)#[^'\"]*$", "", raw)
        if m := re.match(r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{?|^\s*function\s+([A-Za-z_][\w-]*)\s*\{?", line):
            scope, depth = m[1] or m[2], 0
            yield row("symbol", scope, "function", start=k + 1, end=block_end(lines, k) + 1)
            body = line[m.end() :]
            depth += "{" in m[0]
        else:
            body = line
        for m in re.finditer(r"\$\{?([A-Za-z_]\w*)", body):
            yield row("env", m[1], "read", scope, start=k + 1)
        if m := re.match(r"^\s*(?:export\s+|local\s+|readonly\s+)?([A-Za-z_]\w*)=", body):
            yield row("env", m[1], "write", scope, start=k + 1)
        for part in re.split(r"&&|\|\||;|\||\$\(|`", body):
            words = [w for w in part.split() if not re.match(r"^[A-Za-z_]\w*=", w)]
            while words and words[0] in _SHELL_WORDS | {"sudo", "exec", "command"}:
                words.pop(0)
            if not words or not re.match(r"^[\w./~-]+$", words[0]) or words[0] in ("export", "local", "readonly", "return", "exit", "set", "shift", "break", "continue"):
                continue
            if words[0] in ("source", ".") and len(words) > 1:
                yield row("import", words[1].strip("'\"").split("/")[-1], "source", scope, start=k + 1, target=words[1].strip("'\""), confidence=0.85)
            else:
                yield row("call", words[0], "command", scope, start=k + 1, target=words[0])
        plain = re.sub(r"\$\{[^}]*\}", "", body)
        depth += plain.count("{") - plain.count("}")
        if scope and depth <= 0 and "}" in plain:
            scope, depth = "", 0


def markdown(path: str, text: str) -> Iterator[tuple]:
    section, fenced = None, False
    for k, line in enumerate(text.split("\n")):
        if re.match(r"^ {0,3}```", line):
            fenced = not fenced
            if fenced:
                yield row("fence", line.strip("` ") or None, "code", section, start=k + 1)
            continue
        if fenced:
            continue
        if m := re.match(r"^(#{1,6})\s+(.*)", line):
            section = m[2].strip()
            yield row("section", section, f"h{len(m[1])}", start=k + 1)
        for m in re.finditer(r"\[([^\]]*)\]\(([^)\s]*)\)", line):
            yield row("link", m[1], "external" if "://" in m[2] else "local", section, start=k + 1, target=m[2])
        for m in re.finditer(r"`([A-Za-z_][\w:.]*)(?:\(\))?`", line):
            yield row("mention", m[1], "symbol", section, start=k + 1)


SCANNERS = {"rust": rust, "python": python, "typescript": script, "javascript": script, "arkts": arkts, "c": c, "cpp": cpp, "cangjie": cangjie, "shell": shell, "markdown": markdown}


def strip_json_comments(text: str) -> str:
    """JSON without // and /* */ comments; those inside strings stay."""
    return re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', lambda m: m[0] if m[0][0] == '"' else "", text, flags=re.S)


def manifest(path: str, text: str) -> Iterator[tuple]:
    """Packages, targets, workspace members and dependencies of a manifest, by its file name."""
    name = path.rsplit("/", 1)[-1]
    if name in ("Cargo.toml", "cjpm.toml", "pyproject.toml"):
        import tomllib

        data = tomllib.loads(text)
        project = data.get("package") or data.get("project") or {}
        if "name" in project:
            yield row("package", project["name"], name, target=project.get("version") if isinstance(project.get("version"), str) else None)
        for x in data.get("workspace", {}).get("members", []):
            yield row("member", x, "glob" if "*" in x else "path")
        for kind in ("lib", "bin", "example", "test", "bench"):
            found = data.get(kind, [])
            for x in [found] if isinstance(found, dict) else found:
                yield row("target", x.get("name") or project.get("name", "").replace("-", "_"), kind, target=x.get("path"))
        for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
            found = data.get(kind) or {}
            for k, v in found.items() if isinstance(found, dict) else []:
                yield row("dependency", k, kind, target=v if isinstance(v, str) else v.get("path") or v.get("version"), confidence=0.85 if isinstance(v, dict) and "path" in v else None)
        for x in data.get("project", {}).get("dependencies", []):
            yield row("dependency", re.split(r"[ <>=!~\[;]", x)[0], "dependencies", target=x)
    elif name == "package.json":
        data = json.loads(text)
        yield row("package", data.get("name"), name, target=data.get("version"))
        for x in data["workspaces"] if isinstance(data.get("workspaces"), list) else []:
            yield row("member", x, "glob" if "*" in x else "path")
        for k in ("main", "module", "types", "browser"):
            if isinstance(data.get(k), str):
                yield row("entry", k, "entry", target=data[k], confidence=0.80)
        for kind in ("dependencies", "devDependencies", "peerDependencies"):
            for k, v in (data.get(kind) or {}).items():
                yield row("dependency", k, kind, target=v)
        for k, v in (data.get("scripts") or {}).items():
            yield row("script", k, "script", target=v)
    elif name == "requirements.txt":
        for k, line in enumerate(text.split("\n")):
            if m := re.match(r"^\s*([A-Za-z0-9][\w.-]*)\s*(.*)$", line.split("#")[0]):
                yield row("dependency", m[1], "dependencies", start=k + 1, target=m[2].strip() or None)
    elif name.startswith("tsconfig") and name.endswith(".json"):
        data = json.loads(re.sub(r",(\s*[}\]])", r"\1", strip_json_comments(text)))
        options = data.get("compilerOptions", {})
        if "extends" in data:
            yield row("extends", name, "extends", target=data["extends"])
        if "baseUrl" in options:
            yield row("base-url", name, "baseUrl", target=options["baseUrl"])
        for k, v in options.get("paths", {}).items():
            for j, x in enumerate(v):
                yield row("mapping", k, "paths", start=j, target=x)
    elif name == "compile_commands.json":
        import shlex

        for k, entry in enumerate(json.loads(text)):
            words = entry.get("arguments") or shlex.split(entry.get("command", ""))
            for j, w in enumerate(words):
                if m := re.match(r"^(-iquote|-isystem|-include|-I|-D)(.*)$", w):
                    yield row("flag", entry.get("file"), m[1], start=k, target=m[2] or (words[j + 1] if j + 1 < len(words) else None))
    elif name == "cjpm-tree.txt":
        at: list[str] = []
        for line in filter(str.strip, text.split("\n")):
            m = re.match(r"^([\s│├└─|`+-]*)(\S+)", line)
            depth = len(m[1]) // 4
            at = [*at[:depth], m[2]]
            yield row("dependency", m[2], "tree", target=at[depth - 1] if depth else None, start=depth)


def language_of(path: str) -> str:
    return LANGUAGES.get(path.rsplit(".", 1)[-1], "")


def extract(path: str, text: str) -> list[tuple]:
    """All fact rows of a file, an `error` row where it can't be read."""
    language = language_of(path)
    try:
        rows = list(SCANNERS[language](path, text)) if language else list(manifest(path, text))
    except (SyntaxError, ValueError, KeyError, TypeError, RecursionError) as e:
        rows = [row("error", type(e).__name__, "parse", detail=str(e)[:200])]
    return [(path, language or "manifest", *r) for r in rows]


def facts(files: DataFrame) -> DataFrame:
    """The fact table of files(path, text); null texts have none."""
    kinds = [pa.int64() if n.startswith("line") else pa.float64() if n == "confidence" else pa.string() for n in COLUMNS]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)

    def run(batches):
        held = []  # small files share a batch
        for batch in batches:
            for path, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if text is not None:
                    held += extract(path, text)
                if len(held) >= BATCH:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return files.select("path", F.col("text")).mapInArrow(run, SCHEMA)
