"""Programming languages as data: extensions, comments, and the shapes of definitions, imports and entry points.

A line of code is cut into tokens, and a shape is a row of tokens in their order:

    word|other   one of these words      NAME   an identifier, the result     *      any identifier
    word?        the word, or nothing    PATH   a qualified name, the result  TEXT   a quoted string, the result
    <TEXT>       text in angle brackets  (...)  all up to its end             ...    any tokens
    ^, $         begin and end of line   0      a number
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

_TOKEN = re.compile(r"""\"[^"]*\"?|'[^']*'?|[A-Za-z_$][\w$]*|\d+|\S""")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")


@dataclass(frozen=True)
class Language:
    """How one language writes comments, definitions, imports and entry points."""

    name: str
    extensions: tuple[str, ...]
    line_comments: tuple[str, ...]
    block: tuple[str, str] | None
    style: str
    modifiers: str
    definitions: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    entries: tuple[tuple[str, str], ...] = ()
    #: Characters that join the parts of a qualified name, and those that may end a name.
    joints: str = "."
    endings: str = ""
    #: Whether functions are written as in C: types, a name, parameters and an opening brace, from the first column on.
    c_functions: bool = False

    def definition(self, line: str) -> tuple[str, str] | None:
        """(name, kind) of what a line of code defines."""
        tokens = list(_TOKEN.finditer(line))
        words, skip, first = [t[0] for t in tokens], set(self.modifiers.split()), 0
        while first < len(words) and words[first] in skip:
            first += 1
        for shape, kind in self.definitions:
            at = _walk(shape.split(), tokens, first, self.joints)
            if at is not None and at[0] is not None:
                name, end = at
                after = line[end : end + 1]
                return (name + after if after and after in self.endings else name), kind
        return _c_function(line, words) if self.c_functions else None

    def imported(self, line: str) -> list[str]:
        """What a line of code imports, by each shape that it has."""
        return [found for shape in self.imports if (found := _anywhere(shape, line, self.joints)) is not None]

    def entered(self, line: str) -> list[str]:
        """Kinds of the entry points in a line of code."""
        return [kind for shape, kind in self.entries if _anywhere(shape, line, self.joints) is not None]


def _walk(shape: Sequence[str], tokens: list[re.Match], at: int, joints: str) -> tuple[str | None, int] | None:
    """(result, end in the line) if the tokens from `at` on have the shape."""
    found, end = None, tokens[at - 1].end() if at and tokens else 0
    for k, part in enumerate(shape):
        token = tokens[at][0] if at < len(tokens) else ""
        if part == "...":
            rest = (_walk(shape[k + 1 :], tokens, i, joints) for i in range(at, len(tokens)))
            return next((r for r in rest if r is not None), None)
        if part == "$":
            if token:
                return None
            continue
        if part.endswith("?"):
            if token and (token == part[:-1] or (part == "*?" and _IDENTIFIER.fullmatch(token))):
                at += 1
            continue
        if part == "(...)":
            if token != "(":
                return None
            while at < len(tokens) and tokens[at][0] != ")":
                at += 1
        elif part == "NAME":
            if not _IDENTIFIER.fullmatch(token):
                return None
            found, end = token, tokens[at].end()
        elif part == "PATH":
            last = at
            while last < len(tokens) and (_IDENTIFIER.fullmatch(tokens[last][0]) or tokens[last][0] in joints) and (last == at or tokens[last].start() == tokens[last - 1].end()):
                last += 1
            if last == at:
                return None
            found, end, at = "".join(t[0] for t in tokens[at:last]), tokens[last - 1].end(), last - 1
        elif part == "TEXT":
            if token[:1] not in ('"', "'") or not token:
                return None
            found, end = token.strip("\"'"), tokens[at].end()
        elif part == "<TEXT>":
            close = next((i for i in range(at, len(tokens)) if tokens[i][0] == ">"), None)
            if token != "<" or close is None:
                return None
            found, end, at = "".join(t[0] for t in tokens[at + 1 : close]), tokens[close].end(), close
        elif part == "0":
            if not token.isdigit():
                return None
        elif part == "*":
            if not _IDENTIFIER.fullmatch(token):
                return None
        elif not token or (token not in part.split("|") and token != part):
            return None
        at += 1
    return found, end


def _anywhere(shape: str, line: str, joints: str) -> str | None:
    """The result ("" if the shape has none) of the first place of a line where the shape stands."""
    tokens, parts = list(_TOKEN.finditer(line)), shape.split()
    starts = [0] if parts[0] == "^" else range(len(tokens))
    parts = parts[1:] if parts[0] == "^" else parts
    for at in starts:
        found = _walk(parts, tokens, at, joints)
        if found is not None:
            return found[0] or ""
    return None


def _c_function(line: str, words: list[str]) -> tuple[str, str] | None:
    """The function whose head a line is: from the first column on types, a name, parameters and an opening brace."""
    if not _IDENTIFIER.match(line) or "(" not in words[2:] or ";" in words:
        return None
    at = words.index("(")
    closed = len(words) - 1 - words[::-1].index(")") if ")" in words else 0
    name = words[at - 1]
    heads = all(_IDENTIFIER.fullmatch(w) or w in ("*", "&", ":", "<", ">", ",", "~") for w in words[: at - 1])
    if closed > at and words[closed + 1 : closed + 2] == ["{"] and heads and _IDENTIFIER.fullmatch(name) and name not in NOT_CALLS:
        return name, "function"
    return None


_C_BLOCK = ("/*", "*/")
_JS_FUNCTIONS = (("function NAME", "function"), ("function * NAME", "function"))
_JS_CONSTANTS = (("const NAME = (", "function"), ("const NAME = async (", "function"))
_JS_IMPORTS = ("^ import ... from TEXT", "require ( TEXT )")
_JS_ENTRIES = (("* . get|post|put|delete|patch|use ( TEXT", "route"), (". listen ( 0", "server"))
_INCLUDES = ("^ # include TEXT", "^ # include <TEXT>")
_NAMED_TYPES = tuple((f"{word} NAME", word) for word in ("class", "interface", "enum", "record"))

# The languages whose structure is read, with their extensions, comment marks, style of imports and kinds.
LANGUAGES = (
    Language("Python", (".py",), ("#",), None, "dotted", "async", (("def NAME", "function"), ("class NAME", "class")), (),
             (("^ if __name__ = = TEXT", "main"), ("^ def main (", "main"), ("@ * . get|post|put|delete|patch|route|websocket", "route"))),
    Language("JavaScript", (".js", ".jsx", ".mjs", ".cjs"), ("//",), _C_BLOCK, "relative", "export default async", (*_JS_FUNCTIONS, ("class NAME", "class"), *_JS_CONSTANTS), _JS_IMPORTS, _JS_ENTRIES),
    Language("TypeScript", (".ts", ".tsx"), ("//",), _C_BLOCK, "relative", "export default async abstract declare",
             (*_JS_FUNCTIONS, ("class NAME", "class"), ("interface NAME", "interface"), ("type NAME", "type"), ("enum NAME", "enum"), *_JS_CONSTANTS),
             _JS_IMPORTS, (("@ Get|Post|Put|Delete|Patch", "route"), *_JS_ENTRIES)),
    Language("Java", (".java",), ("//",), _C_BLOCK, "dotted", "public private protected abstract final static sealed strictfp", _NAMED_TYPES,
             ("^ import static? PATH",), (("public static void main (", "main"), ("@ GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping", "route"))),
    Language("Kotlin", (".kt", ".kts"), ("//",), _C_BLOCK, "dotted", "public private protected internal suspend data sealed abstract open override inline",
             (("fun NAME", "function"), ("class NAME", "class"), ("object|interface NAME", "type")), ("^ import PATH",), (("^ fun main (", "main"),)),
    Language("Scala", (".scala", ".sc"), ("//",), _C_BLOCK, "dotted", "final abstract sealed case implicit override private protected",
             (("def NAME", "function"), ("class|trait|object NAME", "class")), ("^ import PATH",), (("^ def main (", "main"), ("extends App", "main"))),
    Language("Go", (".go",), ("//",), _C_BLOCK, "path", "", (("func NAME", "function"), ("func (...) NAME", "function"), ("type NAME struct|interface", "type")),
             ("^ import? *? TEXT $",), (("^ func main (", "main"),)),
    Language("Rust", (".rs",), ("//",), _C_BLOCK, "colons", "pub async const unsafe", (("fn NAME", "function"), ("struct|enum|trait NAME", "type")),
             ("^ use PATH",), (("^ fn main (", "main"),), joints=":"),
    Language("C#", (".cs",), ("//",), _C_BLOCK, "dotted", "public private protected internal abstract sealed static partial readonly",
             (("class NAME", "class"), ("interface NAME", "interface"), ("struct|enum NAME", "type")), ("^ using static? PATH",),
             (("static async? void|Task|int Main (", "main"), ("[ HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch ]", "route"))),
    Language("Ruby", (".rb",), ("#",), None, "relative", "", (("def NAME", "function"), ("class|module NAME", "class")),
             ("^ require|require_relative TEXT",), (("^ if __FILE__ = = $0", "main"),), endings="!?="),
    Language("PHP", (".php",), ("//", "#"), _C_BLOCK, "namespaced", "public private protected static final abstract",
             (("function NAME", "function"), ("class|interface|trait NAME", "class")), ("^ use PATH", "require|require_once|include|include_once (? TEXT"), joints="\\"),
    Language("C", (".c", ".h"), ("//",), _C_BLOCK, "include", "", (), _INCLUDES, (("int main (", "main"),), c_functions=True),
    Language("C++", (".cpp", ".cc", ".cxx", ".hpp", ".hh"), ("//",), _C_BLOCK, "include", "", (("class|struct NAME", "class"),), _INCLUDES, (("int main (", "main"),), c_functions=True),
)

BY_EXTENSION = {e: lang for lang in LANGUAGES for e in lang.extensions}

# Words before a parenthesis that aren't calls.
NOT_CALLS = (
    "if", "for", "while", "switch", "catch", "return", "function", "def", "fn", "func", "class", "new", "and", "or", "not", "in", "is", "with", "await",
    "yield", "throw", "throws", "try", "else", "elif", "case", "do", "when", "match", "use", "import", "from", "as", "print", "println", "len", "range",
    "str", "int", "list", "dict", "set", "super", "self", "this", "typeof",
)


def language_of(path: str) -> Language | None:
    """The language of a path by its extension."""
    dot = path.rfind(".")
    return BY_EXTENSION.get(path[dot:].lower()) if dot >= 0 else None
