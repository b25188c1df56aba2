"""File scalars: path parts, language, file type, predicates on names and content."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.bind import bind

# Language of a file by its extension.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "tsx": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "json": "json", "md": "markdown", "py": "python", "java": "java", "cs": "csharp",
    "cpp": "cpp", "c": "c", "h": "c", "go": "go", "rs": "rust", "rb": "ruby", "php": "php",
    "html": "html", "css": "css", "scss": "scss", "yml": "yaml", "yaml": "yaml", "xml": "xml",
    "properties": "properties", "env": "properties", "sql": "sql", "sh": "shell",
}
# What makes a file a configuration file.
CONFIG_EXTENSIONS = ("xml", "yaml", "yml", "properties", "env", "json", "toml", "ini", "conf", "config")
CONFIG_WORDS = (
    "config", "settings", "application", "deployment", "manifest", "pom",
    "gradle", "build", "docker", "k8s", "kubernetes",
)
# Marker files of a project, in order of precedence.
PROJECT_MARKERS = (
    ("java", ("pom.xml", "build.gradle")),
    ("node", ("package.json",)),
    ("python", ("pyproject.toml", "requirements.txt")),
    ("rust", ("Cargo.toml",)),
    ("go", ("go.mod",)),
)
# Languages that keep their own name inside a project type.
ECOSYSTEM_OWN = {"java": ("java",), "node": ("javascript", "typescript"), "python": ("python",)}
BINARY_SAMPLE = 4096
BINARY_SHARE = 0.08


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """Parent folder; the root is the empty string."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))


def _is_env(name: Column) -> Column:
    lowered = F.lower(name)
    return (lowered == ".env") | F.startswith(lowered, F.lit(".env."))


def language(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*LANGUAGE_BY_EXTENSION.items())])
    return F.when(_is_env(name), F.lit("properties")).otherwise(
        F.coalesce(F.element_at(table, extension(name)), F.lit("text"))
    )


def _names_config(name: Column) -> Column:
    return F.lower(name).rlike("|".join(CONFIG_WORDS))


def file_type(name: Column) -> Column:
    hit = _is_env(name) | extension(name).isin(*CONFIG_EXTENSIONS) | _names_config(name)
    return F.when(hit, F.lit("configuration")).otherwise(F.lit("source_code"))


def attached_extension(name: Column) -> Column:
    """Dotted extension of an attachment; a leading dot does not start one."""
    last = F.element_at(F.split(name, "/"), -1)
    return F.regexp_extract(last, r".(\.[^.]*)\z", 1)


def file_type_attached(name: Column) -> Column:
    dotted = [f".{e}" for e in CONFIG_EXTENSIONS]
    hit = F.lower(attached_extension(name)).isin(*dotted) | _names_config(name)
    return F.when(hit, F.lit("configuration")).otherwise(F.lit("source_code"))


def ecosystem_language(lang: Column, project_type: Column) -> Column:
    out = lang
    for project, own in ECOSYSTEM_OWN.items():
        out = F.when(
            project_type == project,
            F.when(lang.isin(*own), lang).otherwise(F.lit(f"{project}-ecosystem")),
        ).otherwise(out)
    return out


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("::chunk-"), index.cast("string"))


def embedding_input(*fields: Column) -> Column:
    """Path, name, extension, folder, language, type, class, method, project, content."""
    if len(fields) != 10:
        raise ValueError("an embedding input has ten fields")
    return F.concat_ws("\n", *[F.coalesce(f, F.lit("")) for f in fields])


def is_binary(content: Column, sample: int | None = BINARY_SAMPLE) -> Column:
    """Judged by the first ``sample`` characters, with None by the whole text."""

    def test(part):
        length = F.length(part)
        controls = length - F.length(F.regexp_replace(part, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
        return F.contains(part, F.lit("\x00")) | (controls / F.greatest(length, F.lit(1)) > BINARY_SHARE)

    return bind(content if sample is None else F.substring(content, 1, sample), test)


def glob_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` does not, every other character is literal."""
    special = set(".*+?^${}()|[]\\")
    out, text, i = [], glob.replace("\\", "/"), 0
    while i < len(text):
        if text.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            ch = text[i]
            out.append("[^/]*" if ch == "*" else ("\\" + ch if ch in special else ch))
            i += 1
    return "".join(out)


def matches_globs(path: Column, globs: Iterable[str]) -> Column:
    patterns = [glob_regex(g.strip()) for g in globs if g.strip()]
    if not patterns:
        return F.lit(False)
    return path.rlike("(?i)^(?:" + "|".join(patterns) + r")\z")


def in_ignored_dir(path: Column, dirs: Iterable[str]) -> Column:
    """True when any folder above the file, at any depth, has an ignored name."""
    names = [d.strip() for d in dirs if d.strip()]
    if not names:
        return F.lit(False)
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, names)))


def normalise_path(path: Column) -> Column:
    """A usable relative path, or null when the entry must be ignored."""
    from corpusloom.functions.text import js_trim

    slashed = F.replace(js_trim(path), F.lit("\\"), F.lit("/"))
    dotted = F.arrays_overlap(F.split(slashed, "/"), F.array(F.lit("."), F.lit("..")))
    ok = ~dotted & ~F.startswith(slashed, F.lit("/")) & slashed.rlike(r"^[A-Za-z0-9_./-]+\z")
    return F.when(ok, slashed)


def collection_id(root: Column, epoch_ms: Column) -> Column:
    from corpusloom.functions.text import SPACE_CLASS, js_trim

    name = F.element_at(F.split(F.regexp_replace(root, r"/+\z", ""), "/"), -1)
    clean = F.regexp_replace(js_trim(name), f"[{SPACE_CLASS}-]+", "_")
    clean = F.regexp_replace(clean, "[^A-Za-z0-9_]", "_")
    clean = F.lower(F.btrim(F.regexp_replace(clean, "_+", "_"), F.lit("_")))
    clean = F.when(clean == "", F.lit("workspace")).otherwise(clean)
    return F.concat(clean, F.lit("_"), epoch_ms.cast("string"))


def hit_label(path: Column, index: Column, count: Column, position: Column | None = None) -> Column:
    """``path [chunk i+1/n]``; the position names a record without a path."""
    shown = path if position is None else F.coalesce(path, F.concat(F.lit("document-"), position.cast("string")))
    suffix = F.when(
        index.isNotNull() & count.isNotNull(),
        F.concat(F.lit(" [chunk "), (index + 1).cast("string"), F.lit("/"), count.cast("string"), F.lit("]")),
    ).otherwise(F.lit(""))
    return F.concat(shown, suffix)
