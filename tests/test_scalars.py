import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import files as ff
from corpusloom.functions import prompting as pr
from corpusloom.functions import scoring as sc
from corpusloom.functions import settings as st
from corpusloom.functions import text as tx
from corpusloom.functions import tokens as tk
from corpusloom.options import ChunkBudgets

C = F.col


@pytest.mark.parametrize("name,ext,lang,kind", [
    ("a.TS", "ts", "typescript", "source_code"),
    ("Makefile", "", "text", "source_code"),
    ("x.", "", "text", "source_code"),
    (".env", "env", "properties", "configuration"),
    (".env.local", "local", "properties", "configuration"),
    ("docker-compose", "", "text", "configuration"),
    ("a.yaml", "yaml", "yaml", "configuration"),
])
def test_file_rules(one, name, ext, lang, kind):
    assert one(ff.extension(C("n")), n=name) == ext
    assert one(ff.language(C("n")), n=name) == lang
    assert one(ff.file_type(C("n")), n=name) == kind


def test_attached_env_is_not_configuration(one):
    assert one(ff.attached_extension(C("n")), n=".env") == ""
    assert one(ff.file_type_attached(C("n")), n=".env") == "source_code"
    assert one(ff.file_type_attached(C("n")), n="a.json") == "configuration"


@pytest.mark.parametrize("path,hit", [
    ("a/b.bin", True), ("b.bin", False), ("A/B.BIN", True), ("a/b.bin.txt", False), ("a/x?.lock", True),
])
def test_globs(one, path, hit):
    assert one(ff.matches_globs(C("p"), ["**/*.bin", "**/*.lock"]), p=path) is hit


def test_glob_stops_at_folder(one):
    assert one(ff.matches_globs(C("p"), ["src/*.c"]), p="src/a/b.c") is False
    assert one(ff.matches_globs(C("p"), ["src\\*.c"]), p="src/b.c") is True


def test_binary(one):
    assert one(ff.is_binary(C("c")), c="a\x00") is True
    assert one(ff.is_binary(C("c")), c="\x01" * 8 + "a" * 92) is False
    assert one(ff.is_binary(C("c")), c="\x01" * 9 + "a" * 91) is True
    assert one(ff.is_binary(C("c")), c="a" * 4096 + "\x00") is False


def test_ignored_dirs(one):
    assert one(ff.in_ignored_dir(C("p"), ["out"]), p="a/out/b.c") is True
    assert one(ff.in_ignored_dir(C("p"), ["out"]), p="a/b/out") is False


@pytest.mark.parametrize("path,clean", [
    (" a\\b.c ", "a/b.c"), ("/a", None), ("a/../b", None), ("./a", None), ("a b", None), ("", None), ("a-b_c.d", "a-b_c.d"),
])
def test_path_filter_entries(one, path, clean):
    assert one(ff.normalise_path(C("p")), p=path) == clean


@pytest.mark.parametrize("root,expected", [
    ("/w/My Project-Name", "my_project_name_1710000000000"),
    ("/w/Project (API) v2/", "project_api_v2_1710000000000"),
    ("/w/()", "workspace_1710000000000"),
])
def test_collection_id(one, root, expected):
    assert one(ff.collection_id(C("r"), F.lit(1710000000000)), r=root) == expected


def test_blank_means_all_unicode_spaces(one):
    assert one(tx.is_blank(C("c")), c=" \t\n 　﻿") is True
    assert one(tx.js_trim(C("c")), c=" a b ") == "a b"


def test_escape_and_control(one):
    assert one(tx.xml_escape(C("c")), c="<a b='1'>&\"") == "&lt;a b=&apos;1&apos;&gt;&amp;&quot;"
    assert one(tx.strip_control(C("c")), c="a\x00\x08\t\n\x0b\x7fb") == "a\t\nb"


def test_names_and_ranges(one):
    assert one(tx.base_name(C("n")), n="a.ts:3-9") == "a.ts"
    assert one(tx.base_name(C("n")), n="a.ts:x") == "a.ts:x"
    assert one(tx.range_label(C("n"), F.lit(2), F.lit(5)), n="a") == "a:2-5"
    assert one(tx.range_label(C("n"), F.lit(2), F.lit(2)), n="a") == "a:2"
    assert one(tx.range_label(C("n"), F.lit(None).cast("int"), F.lit(2)), n="a") == "a"


def test_entities(one):
    code = 'import "lib/core"\nclass Foo {\n  public run(x) { const ab = go(1); let total = 2 } for (i) }'
    assert one(tx.keyword_entities(C("c")), c=code) == ["foo", "run", "total", "lib/core"]


def test_entities_and_symbols_stay_linear(one):
    long = "a" * 200_000 + " (" * 1000
    assert one(F.size(tx.keyword_entities(C("c"))), c=long) == 0
    assert one(tx.java_symbols(C("c"), F.length("c")), c="public " * 50_000).method_name == ""


def test_java_symbols(one):
    code = "class A { void one(int x) { if (x) { } } }\nclass B { int two() { return 1; }"
    both = one(tx.java_symbols(C("c"), F.length("c")), c=code)
    assert (both.class_name, both.method_name) == ("B", "two")
    first = one(tx.java_symbols(C("c"), F.lit(30)), c=code)
    assert (first.class_name, first.method_name) == ("A", "one")


def test_java_symbols_at_every_end(spark):
    rng = random.Random(6)
    bits = ["class ", "Foo", "A1_b", " ", "\n", "{", "}", ";", "(", ")", "void run", "if (x) ", "new B(", "interface\u00a0I", "enum", "record R", "int go () ", "é", ", "]
    texts = ["".join(rng.choices(bits, k=60)) for _ in range(40)] + ["", "class", "class X", "\U0001d518 class Y { void z() {"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, c string")
    ends = F.sequence(F.lit(0), F.length("c"))
    got = rows.select("i", tx.java_symbols_at(C("c"), ends).alias("at"), F.transform(ends, lambda e: tx.java_symbols(C("c"), e)).alias("each"))
    for r in got.collect():
        assert (r.at is None) == (r.i == 99)
        assert r.i == 99 or r.at == r.each, texts[r.i]


def test_symbols_of_a_long_file_take_linear_time():
    from time import perf_counter

    unit = "class Part {\n  public void run(int x) { if (x) { return; } }\n}\n"
    took = []
    for times in (3_000, 12_000):  # 190 and 760 KB
        started = perf_counter()
        starts, _, braces, _ = tx.symbol_positions(unit * times)
        took.append(perf_counter() - started)
        assert len(starts) == len(braces) == times
    assert took[1] < 12 * took[0] + 0.5


def test_tokens_keep_duplicates(one):
    assert one(sc.tokenize(C("c")), c="Foo foo, a b.c/d-e x") == ["foo", "foo", "b.c/d-e"]
    assert one(sc.lexical_path_score(sc.tokenize(C("q")), C("s")), q="foo foo bar", s="my foo") == pytest.approx(2 / 3)
    assert one(sc.lexical_path_score(sc.tokenize(C("q")), C("s")), q="foo", s=" ") == 0
    assert one(sc.lexical_path_score(sc.tokenize(C("q")), C("s")), q="!", s="x") == 0


def test_cosine_guards(one):
    def cos(a, b):
        return one(sc.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))

    assert cos([1.0, 0.0], [1.0, 0.0]) == 1
    assert cos([1.0], [1.0, 2.0]) == 0
    assert cos([0.0, 0.0], [1.0, 2.0]) == 0
    assert one(sc.vector_score(F.lit(None).cast("double"))) == 0
    assert one(sc.vector_score(F.lit(-3.0))) == 1


def test_token_rules(one):
    assert one(tk.chars4(C("c")), c="abcde") == 2
    assert one(tk.message_tokens(F.lit("assistant"), C("c")), c="abcd") == 2
    assert one(tk.safety_threshold(F.lit(8192))) == 6553
    assert tk.prune_target(6500) == 3900
    assert one(tk.map_role(F.lit("system"), legacy_roles=True)) == "human"
    assert one(tk.reply_tokens(F.lit(0), F.lit(16))) == 5
    assert one(tk.reply_tokens(F.lit(7), F.lit(16))) == 7


def test_encoder_counter(one):
    count = tk.encoder_counter(lambda: str.split)
    assert one(count(C("c")), c="a b c") == 3


def test_budgets_are_brought_into_range():
    b = ChunkBudgets(target=900, max=10, min=0, fallback=5)
    assert (b.max, b.target, b.min, b.fallback) == (64, 64, 1, 32)


@pytest.mark.parametrize("text,answer,placeholder", [
    ("Final Answer: yes\nFinal Answer: no", "yes\nFinal Answer: no", False),
    ("final answer:   ", None, True),
    ("nothing", None, True),
    ("Final Answer: <your answer>", "<your answer>", True),
    ("Final Answer: [Your comprehensive text]", "[Your comprehensive text]", True),
])
def test_final_answer(one, text, answer, placeholder):
    assert one(pr.final_answer(C("t")), t=text) == answer
    assert one(pr.is_placeholder(pr.final_answer(C("t"))), t=text) is placeholder


@pytest.mark.parametrize("text,query", [
    ('Thought\nAction: agent_search("a (b) c")', "a (b) c"),
    ("action: search( 'x' )", "x"),
    ("Action: search()\nAction: search(y)", None),
    ('Action: search("a" and "b")', 'a" and "b'),
    ("Action: find(x)", None),
    ("Action: search(x) now", None),
    ("Action:\nsearch(x)", None),
])
def test_action_query(one, text, query):
    assert one(pr.action_query(C("t")), t=text) == query


def test_templates(one):
    assert one(pr.render_fragment(F.lit("F {index} | {path}{distance}\n{content} {index}"), F.lit(1), F.lit("src/a.ts"),
                                  F.lit(" d=0.1"), F.lit("x"))) == "F 1 | src/a.ts d=0.1\nx {index}"
    assert one(pr.render_prompt(F.lit("{{user_query}} {{user_query}} {{target_files}}"), F.lit("$1"), F.lit("f"))) == "$1 $1 f"
    custom = F.parse_json(F.lit('{"m": {"header": "H"}, "system": "old"}'))
    assert one(st.merge_section(custom, "m", {"header": "h", "scope": "s"})).asDict() == {"header": "H", "scope": "s"}
    assert one(st.merge_conversation_template(custom, "S", "U")).asDict() == {"system_prompt": "old", "user_prompt": "U"}


@pytest.mark.parametrize("props,name,ctx", [
    ('{"n_ctx": 4096, "model": "m"}', "m", 4096),
    ('{"default_generation_settings": {"n_ctx": 12, "params": {"model_alias": " x "}}}', "x", 12),
    ('{"model_path": "/a/b.gguf", "model": " "}', "b.gguf", 0),
    ('{}', "local", 0),
])
def test_server_properties(one, props, name, ctx):
    assert one(st.model_name(F.parse_json(C("p"))), p=props) == name
    assert one(st.context_window(F.parse_json(C("p"))), p=props) == ctx


@pytest.mark.parametrize("minutes,age", [(0, "Just now"), (59, "59 min ago"), (120, "2 h ago"), (1440, "Yesterday"), (2880, "2 days ago")])
def test_age(one, minutes, age):
    now = 1_700_000_000_000
    assert one(tx.relative_time(F.lit(now - minutes * 60_000), F.lit(now))) == age


def test_titles(one):
    assert one(tx.session_title(C("t")), t="a" * 41) == "a" * 37 + "..."
    assert one(tx.session_title(C("t")), t="x User instruction: do it") == "do it"
    assert one(tx.session_title(C("t")), t="x User instruction:  ") == "x User instruction:  "
    assert one(tx.query_preview(C("t")), t=" a \n b ") == "a b"
    assert one(tx.duration_seconds(F.lit(1234))) == "1.23"
