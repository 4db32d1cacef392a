"""What a file is, by name: language, text kind, notebook; and whether it is binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Extensions of source languages.
LANGUAGES = {
    "python": ".py .pyi",
    "javascript": ".js .jsx .mjs .cjs",
    "typescript": ".ts",
    "tsx": ".tsx",
    "java": ".java",
    "go": ".go",
    "rust": ".rs",
    "c": ".c .h",
    "cpp": ".cpp .cc .cxx .hpp",
    "c_sharp": ".cs",
    "kotlin": ".kt .kts",
    "scala": ".scala .sc",
    "elixir": ".ex .exs",
    "ruby": ".rb",
    "php": ".php",
    "bash": ".sh .bash .zsh",
    "html": ".html .htm",
    "css": ".css",
    "json": ".json",
    "yaml": ".yaml .yml",
    "markdown": ".md .markdown",
    "swift": ".swift",
    "dart": ".dart",
    "lua": ".lua",
    "zig": ".zig .zon",
    "haskell": ".hs",
    "ocaml": ".ml",
    "ocaml_interface": ".mli",
    "julia": ".jl",
    "perl": ".pl .pm",
    "powershell": ".ps1 .psm1 .psd1",
    "objc": ".m .mm",
    "sql": ".sql",
    "toml": ".toml",
    "xml": ".xml .xsd .xsl .xslt .plist .csproj .vbproj .fsproj .vcxproj .props .targets .pom .nuspec .resx .wsdl .xaml",
    "hcl": ".tf .tfvars .hcl",
    "make": ".mk .mak",
    "svelte": ".svelte",
    "nix": ".nix",
    "groovy": ".groovy .gvy .gradle",
    "fortran": ".f90 .f95 .f03 .f08 .f .for .ftn",
    "verilog": ".v .vh .sv .svh",
    "vhdl": ".vhd .vhdl",
}
#: Extensions that are read as plain text.
TEXTS = {"text": ".txt .rst .adoc .log .tex", "config": ".ini .cfg .conf .env .properties", "data": ".csv .tsv"}
#: Whole names.
NAMES = {"makefile": "make", "gnumakefile": "make", "dockerfile": "text:docker", "jenkinsfile": "groovy", "readme": "text:text", "license": "text:text", "copying": "text:text"}
MAX_FILE_BYTES = 1_500_000


def kind(path: Column) -> Column:
    """Language, text:<kind>, ipynb, or null for what is not read."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    table: dict[str, str] = {".ipynb": "ipynb"}
    for language, exts in LANGUAGES.items():
        table.update({e: language for e in exts.split()})
    for text, exts in TEXTS.items():
        table.update({e: f"text:{text}" for e in exts.split()})
    by_extension = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    by_name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(by_name, name), F.try_element_at(by_extension, extension))


def cp1252(content: Column) -> Column:
    """Bytes as cp1252: Latin-1 but for the 27 characters that it has between 0x80 and 0x9F."""
    own = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    return F.translate(F.decode(content, "iso-8859-1"), "".join(own), "".join(own.values()))


def scan(spark, root: str, ignore: list[str] = ()) -> DataFrame:
    """(path, kind, size, modified, text): readable files under root, by relative path.

    Binary files (a zero byte in the first 8 KB) and files over the size limit
    are left out; bytes that are not UTF-8 are read as cp1252.
    """
    from weftgraph.functions.text import matches_any

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace("path", "^file:/*" + base.lstrip("/") + "/", "")
    rows = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    rows = rows.where((F.col("size") <= MAX_FILE_BYTES) & ~matches_any(F.col("path"), list(ignore))).withColumn("kind", kind(F.col("path"))).where("kind IS NOT NULL")
    rows = rows.where(F.instr(F.hex(F.substring("content", 1, 8192)), "00") % 2 != 1)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), cp1252(F.col("content")))
    return rows.select("path", "kind", "size", "modified", F.regexp_replace(text, "^﻿", "").alias("text"))
