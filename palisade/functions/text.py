"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What sanitize() removes, in this order, for whole escape sequences come before the bytes they consist of.
CONTROL_PATTERNS = [
    r"\x1b\][\s\S]*?(?:\x07|\x1b\\)",
    r"\x1b[PX^_][\s\S]*?\x1b\\",
    r"\x1b\[[\x20-\x2f]*[0-9;?]*[\x20-\x7e]",
    r"\x1b[\x40-\x7e]",
    r"\x1b",
    r"[\x80-\x9f]",
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
]
#: Findings in names, and the characters that make them.
HOMOGLYPHS = [
    ("INVISIBLE_CHARS", r"[\x{200b}-\x{200f}\x{2060}\x{feff}]"),
    ("BIDI_OVERRIDE", r"[\x{202a}-\x{202e}\x{2066}-\x{2069}]"),
    ("NON_ASCII", r"[^\x{0}-\x{7f}]"),
]


def trimmed(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$", "")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def sanitize(text: Column) -> Column:
    """Without terminal escape sequences and control characters; tab and line ends stay."""
    for pattern in CONTROL_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    return text


def normalize_name(name: Column) -> Column:
    """Lower case, each of . and _ becomes a hyphen."""
    return F.regexp_replace(F.lower(trimmed(name)), "[._]", "-")


def homoglyphs(name: Column) -> Column:
    """Types of suspicious characters in a name; an empty array if there are none."""
    return F.array_compact(F.array(*[F.when(name.rlike(pattern), F.lit(kind)) for kind, pattern in HOMOGLYPHS]))


def typosquat_limit(name: Column) -> Column:
    """The largest edit distance at which a name imitates another; 0 for names too short to tell."""
    return F.when(F.length(name) <= 3, 0).when(F.length(name) <= 6, 1).otherwise(2)


#: Shells and the interpreter, and their flags that take code as the next word.
SHELLS, SHELL_FLAGS = ["sh", "bash"], ["-c"]
INTERPRETERS, CODE_FLAGS = ["node"], ["-e", "--eval"]
#: Programs whose commands are no JavaScript, whatever follows them.
TOOLS = ["python", "ruby", "perl", "npm", "npx", "yarn", "pnpm"]
QUOTES = ["'", '"']


def _word(words: Column, k: Column) -> Column:
    return F.get(words, k)["text"]


def _calls(words: Column, programs: list[str], flags: list[str]) -> Column:
    """Where in ``words`` a program, a flag and a quote follow each other: the places of the quotes among the pieces."""
    last = F.size(words) - 3
    fits = lambda k: _word(words, k).isin(programs) & _word(words, k + 1).isin(flags) & _word(words, k + 2).isin(QUOTES)
    starts = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), fits)
    return F.transform(starts, lambda k: F.get(words, k + 2)["at"])


def inline_js(script: Column) -> Column:
    """JavaScript that a lifecycle script passes to an interpreter; null if it only runs files or other tools.

    The script is cut into words, quotes and blanks. A quoted word that an interpreter takes as code counts wherever it stands. Else what the
    innermost shell gets is taken as JavaScript if it has signs of it, and its first word is no tool and no script file.
    """
    pieces = F.regexp_extract_all(script, F.lit("""['"]|\\s+|[^\\s'"]+"""), F.lit(0))
    placed = F.transform(pieces, lambda t, k: F.struct(k.alias("at"), t.alias("text")))
    words = F.filter(placed, lambda w: ~w["text"].rlike(r"^\s"))
    code_at = F.get(_calls(words, INTERPRETERS, CODE_FLAGS), F.lit(0))
    behind = F.slice(pieces, code_at + 2, F.size(pieces))
    length = F.array_position(behind, F.get(pieces, code_at)).cast("int") - 1
    argument = F.when(length > 0, F.array_join(F.slice(behind, F.lit(1), length), ""))
    shells = _calls(words, SHELLS, SHELL_FLAGS)
    inner = F.slice(pieces, F.element_at(shells, F.size(shells)) + 2, F.size(pieces))
    closing = F.concat(F.lit(r"""(?:['"]\s*){"""), F.size(shells).cast("string"), F.lit("}$"))  # a quote for each shell
    command = F.when(F.size(shells) > 0, F.regexp_replace(F.array_join(inner, ""), closing, F.lit(""))).otherwise(script)
    first, second = F.split_part(command, F.lit(" "), F.lit(1)), F.split_part(command, F.lit(" "), F.lit(2))
    is_file = lambda w: F.regexp_extract(w, r"^[^;|&]*", 0).rlike(r"\.[mc]?js$")
    other = first.isin(TOOLS) | (first.isin(INTERPRETERS) & is_file(second)) | (first.rlike(r"^\.?/") & (is_file(first) | is_file(second)))
    signs = F.length(F.translate(command, ";{}()=", "")) < F.length(command)
    signs = signs | F.exists(F.split(command, r"\W+"), lambda w: w.isin("require", "import", "eval"))
    return F.coalesce(argument, F.when(signs & ~other, command))


def encode_package(name: Column) -> Column:
    """A name for a URL path: the scope's @ stays, the rest is percent-encoded."""
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.when(name.startswith("@"), F.concat(F.lit("@"), encoded(F.substring(name, 2, 2**31 - 1)))).otherwise(encoded(name))


def shell_quoted(text: Column) -> Column:
    """Safe as one shell word: plain words stay, others are quoted."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(text.rlike(r"^[A-Za-z0-9@/._:+-]+$"), text).otherwise(quoted)


def url_problem(url: Column, hosts: list[str]) -> Column:
    """Why an archive's URL isn't allowed: INVALID_URL, NOT_HTTPS or HOST_NOT_ALLOWED; null if it is."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    return F.when(scheme.isNull() | host.isNull(), "INVALID_URL").when(F.lower(scheme) != "https", "NOT_HTTPS").when(~F.lower(host).isin(hosts), "HOST_NOT_ALLOWED")
