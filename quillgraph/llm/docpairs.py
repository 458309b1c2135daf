"""Functions paired with their documentation.

A recursive pattern captures a comment, the signature it stands before (or
whose body it opens) and the balanced body in one match.  Brackets are
balanced by recursion, and strings and comments inside them are taken as a
whole, so that a bracket within one doesn't count.  What is captured is
cleaned of its comment marks and dropped where it says nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A comment, then a signature, then (optionally) a body.
_PARTS = r"""
(?(DEFINE)
  (?P<string> "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' | `(?:[^`\\]|\\.)*+` )
  (?P<note> /\*(?:[^*]|\*(?!/))*+\*/ | //[^\n]*+ )
  (?P<parens> \( (?: [^()"'`/] | (?&string) | (?&note) | (?&parens) | ["'`/] )*+ \) )
  (?P<braces> \{ (?: [^{}"'`/] | (?&string) | (?&note) | (?&braces) | ["'`/] )*+ \} )
)
"""
_COMMENT = r"""
(?P<comment>
    /\*(?:[^*]|\*(?!/))*+\*/
  # Lines of comment are taken from the first on only, so that a long block is read once.
  | (?<! ^[ \t]*//[^\n]*\n[ \t]*) (?: [ \t]* // [^\n]*+ (?:\n|\Z) )++
  | (?<! ^[ \t]*\#[^\n]*\n[ \t]*) (?: [ \t]* \# [^\n]*+ (?:\n|\Z) )++
  | (?<! ^[ \t]*--[^\n]*\n[ \t]*) (?: [ \t]* -- [^\n]*+ (?:\n|\Z) )++
  | \"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}
  | '{3}(?:[^'\\]|\\.|'(?!''))*+'{3}
)
"""
_UNIT = regex.compile(
    _PARTS + r"\A" + _COMMENT + r"\s*+ (?P<signature> (?P<name>[^\s(]*+) \s*+ (?P<params>(?&parens)) [^{;\n]*+ ) (?P<body>(?&braces))? ",
    regex.VERBOSE | regex.DOTALL,
)
_HEAD = r"""
(?P<indent>[ \t]*+)
(?P<signature>
  (?: (?:@[\w.]++(?:(?&parens))?\s*+) )*+
  (?: (?:export|default|public|private|protected|static|final|abstract|async|pub|const|unsafe|extern|inline|override|virtual)\s++ )*+
  (?: (?:def|fn|func|function|fun|sub)\s++ (?:(?&parens)\s*+)? | (?!(?:class|record|struct|interface|enum|trait|new)\s | (?:if|for|foreach|while|switch|catch|else|elif|return|throw|await|yield)\b | (?:when|using|lock|synchronized|with|match)\s+\()
        (?:[\w<>\[\]*&:.,?]++\s++)?(?=[A-Za-z_]\w*\s*(?&parens)[^;{}]*\{) )
  (?P<name>[A-Za-z_]\w*+[?!]?) \s*+ (?:<[^<>]*+>)? (?P<params>(?&parens))? (?:[^:{;\n]|:(?![ \t]*\n))*+
)
"""
#: A comment before a definition with a body in braces, or with an indented one.
_SOURCE = regex.compile(
    _PARTS + r"^[ \t]*+" + _COMMENT + r"(?:[ \t]*+\n)*+" + _HEAD + r":?[ \t]*+(?P<body>(?&braces) | (?:\n (?P=indent)[ \t]++ [^\n]*+ | \n[ \t]*+(?=\n) )++ )",
    regex.VERBOSE | regex.DOTALL | regex.MULTILINE,
)
#: A definition with an indented body that opens with its documentation.
_SOURCE_INNER = regex.compile(
    _PARTS
    + r"^"
    + _HEAD
    + r":[ \t]*\n (?P=indent)[ \t]++ (?P<comment>\"{3}(?:[^\"\\]|\\.|\"(?!\"\"))*+\"{3} | '{3}(?:[^'\\]|\\.|'(?!''))*+'{3})"
    + r"(?P<body>(?:\n (?P=indent)[ \t]++ [^\n]*+ | \n[ \t]*+(?=\n) )*+ )",
    regex.VERBOSE | regex.DOTALL | regex.MULTILINE,
)

# Keys of the metadata that hold documentation, most specific first.
DOC_KEYS = ("docstring", "doc", "documentation", "leading_comment", "comment", "description", "summary")

# Texts that say nothing, in lower case, letters and spaces only.
STUBS = frozenset(
    """
    todo|fixme|xxx|tbd|tba|tbc|wip|hack|n a|na|none|null|nil|nothing|empty|blank|desc|descr|description|doc|docs|docstring|
    documentation|comment|summary|undocumented|not documented|to be documented|to be done|to be defined|to be determined|
    to be written|to do|no description|no docs|no documentation|no comment|no docstring|no description available|
    no documentation available|description here|add description|add description here|add docstring|add docstring here|
    add documentation|add documentation here|add docs|insert description here|write me|fill me in|fill in|fill this in|
    placeholder|stub|method stub|function stub|auto generated|auto generated method stub|auto generated function stub|
    autogenerated|auto generated constructor stub|auto generated catch block|generated method stub|todo auto generated method stub|
    work in progress|coming soon|missing|missing docstring|missing documentation|unknown|self explanatory|obvious|
    default constructor|constructor|ctor|destructor|default destructor|getter|setter|default implementation|
    document|document me|document this|needs documentation|add doc|pending|later|lorem ipsum|foo|foo bar|test|method|function|
    """.replace("\n", "").replace("    ", "").split("|")
) - {""}

_MARKS = regex.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|///?!?|#+!?|--+|;+|\"{3}|'{3})?[ \t]?|(?:\*+/|\"{3}|'{3})\s*$", regex.MULTILINE)
_TAGS = regex.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", regex.DOTALL)
_TODO = regex.compile(r"\A(?:todo|fixme|xxx|tbd|wip|hack)\b[\s:!.(\-]*+(?:(?:add|write|improve|fix|need|needs)?\s*(?:me|this|it|the)?\s*(?:document(?:ation|ed|s)?|docs?|docstrings?|descri(?:be|ption)|comments?|explain|write|fill(?: in)?)?)[\s.!)]*\Z", regex.IGNORECASE)
_TOOL = regex.compile(
    r"""\A[\s@#!/*-]*(?:
      noqa\b|nolint\b|nosec\b|nopep8\b|fmt:\s*(?:on|off|skip)|yapf:|isort:|type:\s*ignore|pyright:|mypy:|ruff:|flake8:|pylint:|pragma[:\s]|
      eslint(?:-|\b)|jshint\b|jslint\b|tslint:|prettier-ignore|istanbul\s+ignore|c8\s+ignore|v8\s+ignore|clang-format\b|clang-tidy\b|NOLINT|
      rubocop:|rustfmt::|clippy::|go:\w|\+build\b|lint:|coverage:|cspell|stylelint|webpack\w*:|sourceMappingURL|@ts-|ts-(?:ignore|expect-error|nocheck)|
      @?formatter:(?:on|off)|region\b|endregion\b|CHECKSTYLE|NOSONAR|@?SuppressWarnings|biome-ignore|deno-lint|phpcs:|@?codeCoverageIgnore|swiftlint:|ktlint|detekt|vim?:|ex:\s*set|-\*-|coding[:=]|language=
    )""",
    regex.VERBOSE | regex.IGNORECASE,
)
_POINTER = regex.compile(
    r"""\A[\s({\[]*+@?(?:
      (?:please\s+)?(?:see|cf\.?|refer\s+to|as\s+in|same\s+as|like|consult|look\s+at|check|described\s+in|documented\s+in|defined\s+in|inherited\s+from|inherits?\s+from|overrides?|implements|copied\s+from|delegates\s+to)\b
        (?:\s+(?:the|its|also|docs?|documentation|of|for|in|above|below|base|parent|super|class|classes|interface|superclass|method|function|module|header|file|readme|wiki|details?|comment|description|more|information|previous|one|other|overload|implementation|declaration|javadoc|at|\{?@?link|[\w./]*[#.:_/(\d][\w.()\#:/_-]*+|[`'\"<\[][^`'\"<>\]]*+[`'\">\]]))*+
      |\{?@?inherit_?docs?\}? | inherit(?:s|ed)? | overrid(?:es?|den) | see_?also\b.{0,60} | (?:ditto|idem)
    )[\s.)}\]!:;]*+\Z""",
    regex.VERBOSE | regex.IGNORECASE,
)
_LEGAL = regex.compile(
    r"\A\W*(?:copyright\b|\(c\)\s|©|spdx-|licen[cs]ed\s+under|license:|all\s+rights\s+reserved|this\s+file\s+is\s+part\s+of|permission\s+is\s+hereby|@license\b|@copyright\b|redistribution\s+and\s+use|use\s+of\s+this\s+source\s+code)",
    regex.IGNORECASE,
)
_TAG_LINE = regex.compile(r"\A\s*(?:[@\\:](?P<tag>[A-Za-z]++)\b|(?P<field>Args|Arguments|Parameters|Params|Returns?|Raises|Throws|Yields|Examples?|Notes?)\s*:)\s*+(?P<rest>.*)\Z", regex.DOTALL)
_NAMED_TAGS = frozenset("param params parameter arg argument type rtype vartype raises raise throws exception property template tparam typeparam".split())
_BARE_TAGS = frozenset("return returns override see link deprecated since version author authors inheritdoc private public protected internal static final abstract readonly async constructor class function method memberof module namespace ignore hidden api test nullable nonnull suppresswarnings safevarargs functionalinterface".split())
_CODE = regex.compile(
    r"""\A\s*(?:
        [\w.\[\]"'>-]+\s*(?:=|:=|\+=|-=)\s*[^=].*            # an assignment
      | (?:(?:return|throw|raise|yield|await|import|from|del|assert|print|echo|let|var|const|def|fn|func|function|use|require|include|package|goto)\b(?=.*[(){}\[\];='"]|\s+\w+\s*;?\s*\Z)).*
      | (?:if|for|while|switch|elif|else\s+if|catch)\s*\(.*  # a statement with its bracket
      | (?:if|for|while|elif|with|else|try)\b[^.?!]*:\s*\Z
      | [\w.:>-]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{]?  # a lone call
      | [{}()\[\];]+ | \}\s*else\s*\{ | .*[;{]\s*\Z
    )\Z""",
    regex.VERBOSE | regex.DOTALL,
)
_WORD = regex.compile(r"[\p{Lu}]?[\p{Ll}\p{M}]+|\p{Lu}+(?!\p{Ll})|\p{Lo}+|\d+")
# Words that add nothing to the words of a name.
FILLERS = frozenset(
    "a an the this that it is of to for in on and or function functions method methods func procedure routine constructor "
    "class helper member implementation implements does do performs perform executes run runs called named name returns return".split()
)


def clean(comment: str) -> str:
    """The text of a comment without comment marks, markup tags and surrounding space."""
    # Twice: line marks may stand inside a block comment.
    text = _MARKS.sub("", _MARKS.sub("", comment))
    text = _TAGS.sub(" ", text)
    return "\n".join(line.strip() for line in text.strip().splitlines()).strip()


def _stem(word: str) -> str:
    """A rough stem: enough to tell 'reloads' and 'reloading' from other words."""
    for end in ("ing", "ies", "es", "ed", "s", "e", "y"):
        if len(word) - len(end) >= 3 and word.endswith(end):
            return word[: -len(end)]
    return word


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def trivial(text: str, name: str) -> str:
    """Why a cleaned documentation says nothing, or the empty string."""
    if not text or not any(ch.isalpha() for ch in text):
        return "empty"
    flat = " ".join(regex.sub(r"[^\p{L}\p{M}]+", " ", text).lower().split())
    if flat in STUBS or _TODO.match(text):
        return "stub"
    if _TOOL.match(text):
        return "tool"
    if _POINTER.match(text):
        return "pointer"
    if _LEGAL.match(text):
        return "legal"
    lines = [x for x in text.splitlines() if x.strip()]
    prose, described = [], False
    for line in lines:
        m = _TAG_LINE.match(line)
        if m is None:
            prose.append(line)
            continue
        rest = m["rest"].strip()
        tag = (m["tag"] or m["field"]).lower()
        if tag in _NAMED_TAGS:
            # The name and a type in braces are no description.
            rest = regex.sub(r"\A(?:\{[^{}]*\}\s*)?[\w.$*&\[\]]+\s*[:\-]*\s*", "", rest)
        elif tag in ("return", "returns", "rtype", "type"):
            rest = regex.sub(r"\A\{[^{}]*\}\s*", "", rest).lstrip(": ")
        elif tag in _BARE_TAGS and tag not in ("deprecated",):
            rest = ""
        if len(_words(rest)) >= (1 if tag in _NAMED_TAGS else 2):
            described = True
    if not prose and not described:
        return "bare tags"
    if prose and not described:
        if all(_CODE.match(x) for x in prose):
            return "code"
        own = {_stem(w) for w in _words(name)}
        said = {_stem(w) for w in _words(" ".join(prose)) if w not in FILLERS}
        if said <= own:
            return "name"
        joined = "".join(_words(name))
        if "".join(w for w in _words(" ".join(prose)) if w not in FILLERS) == joined:
            return "name"
    return ""


def read_metadata(text: str | None) -> dict:
    """The object in a metadata text, also where it was encoded twice; empty where it can't be read."""
    for _ in range(3):
        if not isinstance(text, str):
            break
        try:
            text = json.loads(text)
        except ValueError:
            return {}
    return text if isinstance(text, dict) else {}


def _documentation(meta: dict) -> str | None:
    for key in DOC_KEYS:
        value = meta.get(key)
        if isinstance(value, dict):
            value = _documentation(value) or next((v for k, v in value.items() if k in ("text", "body", "value")), None)
        if isinstance(value, list):
            value = "\n".join(v for v in value if isinstance(v, str))
        if isinstance(value, str) and value.strip():
            return value
    return None


_IS_COMMENT = regex.compile(r"\A\s*" + _COMMENT + r"\s*\Z", regex.VERBOSE | regex.DOTALL)


def pair_of(name: str | None, metadata: str | None) -> tuple[str, str, str, str] | None:
    """(signature, parameters, documentation, reason it is dropped or '') of one node, or None without documentation."""
    meta = read_metadata(metadata)
    doc = _documentation(meta)
    if doc is None:
        return None
    parameters = meta.get("parameters") if isinstance(meta.get("parameters"), list) else []
    signature = meta.get("signature") if isinstance(meta.get("signature"), str) and "(" in meta.get("signature") else None
    signature = signature or f"{name or ''}({', '.join(map(str, parameters))})"
    comment = doc.strip()
    if not _IS_COMMENT.match(comment):
        comment = "/** " + comment.replace("*/", "* /") + " */"
    unit = _UNIT.match(f"{comment}\n{signature}")
    if unit is None:
        return signature, "", clean(comment), "no unit"
    text = clean(unit["comment"])
    return unit["signature"].strip(), unit["params"][1:-1].strip(), text, trivial(text, name or unit["name"])


_PAIRS = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("parameters", T.StringType()),
        T.StructField("documentation", T.StringType()),
    ]
)


def documented_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, name, signature, parameters, documentation) of functions and methods that are documented.

    ``nodes`` has (id, node_type, name, metadata_json).  Node types count in
    any letter case.  Null, broken or non-object metadata and documentation
    that says nothing give no row; metadata encoded twice is read.  A null name
    is an empty one.  A row that is repeated comes out as often.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node_id, name, meta in zip(batch["id"], batch["name"], batch["metadata_json"]):
                got = pair_of(name, meta)
                if got is not None and not got[3]:
                    out.append((node_id, name, *got[:3]))
            yield pd.DataFrame(out, columns=_PAIRS.names)

    rows = nodes.where(F.lower("node_type").isin("function", "method") & F.col("metadata_json").isNotNull() & F.col("id").isNotNull())
    return rows.select("id", "name", "metadata_json").mapInPandas(pairs, _PAIRS)


#: Comments, and strings; those that may go over several lines are named.
_QUOTED = regex.compile(
    r"""/\*.*?\*/ | //[^\n]*+ | \#[^\n]*+ | (?P<long>\"{3}.*?\"{3} | \'{3}.*?\'{3} | `(?:[^`\\]|\\.)*+`) | "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+'""",
    regex.VERBOSE | regex.DOTALL,
)


def _nested(pattern: regex.Pattern, text: str) -> Iterator[regex.Match]:
    """The matches of a pattern, also those within the body of another, but not within a string there."""
    at = end = 0
    quoted: list[tuple[int, int]] | None = None
    while m := pattern.search(text, at):
        if m.start() < end and quoted is None:
            quoted = [q.span() for q in _QUOTED.finditer(text) if q["long"]]
        if m.start() < end and any(x < m.start() < y for x, y in quoted):
            at = m.start("signature")
            continue
        yield m
        at, end = m.start("body"), max(end, m.end())


def source_units(text: str) -> list[tuple[str, str, str, str]]:
    """(name, signature, body, documentation) of the documented definitions in a source text, nested ones too."""
    inner = list(_nested(_SOURCE_INNER, text))
    # A docstring is no comment of what follows it in the body.
    taken = {m.start("comment") for m in inner}
    out = []
    for m in [m for m in _nested(_SOURCE, text) if m.start("comment") not in taken] + inner:
        doc = clean(m["comment"])
        if not trivial(doc, m["name"]):
            out.append((m["name"], m["signature"].strip(), m["body"].strip("\n"), doc))
    return out


def documented_sources(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, signature, body, documentation): the documented definitions in whole source texts.

    Null and empty texts give no row.  A definition whose brackets don't
    balance is no definition.
    """
    schema = T.StructType(
        [T.StructField(id_col, documents.schema[id_col].dataType)]
        + [T.StructField(c, T.StringType()) for c in ("name", "signature", "body", "documentation")]
    )

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *u) for i, text in zip(batch[id_col], batch[text_col]) for u in source_units(text)]
            yield pd.DataFrame(rows, columns=schema.names)

    return documents.where(F.length(text_col) > 0).select(id_col, text_col).mapInPandas(units, schema)
