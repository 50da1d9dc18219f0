"""Column functions against literals."""

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import urls as U


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).collect()[0]["y"]


def test_frontmatter_and_body(spark):
    t = "---\nstatus: draft\ntitle: \"A: b\"\nsources: []\n---\nBody [[A|b]]\n"
    assert one(spark, t, T.frontmatter) == 'status: draft\ntitle: "A: b"\nsources: []'
    assert one(spark, t, T.body) == "Body [[A|b]]\n"
    assert one(spark, t, lambda c: T.field(T.frontmatter(c), "title")) == "A: b"
    assert one(spark, t, lambda c: T.field(T.frontmatter(c), "created")) is None
    assert one(spark, t, lambda c: T.declares_no_sources(T.frontmatter(c))) is True
    assert one(spark, "no block", T.frontmatter) == "" and one(spark, "no block", T.body) == "no block"


def test_wikilinks_keep_order_and_repeats(spark):
    assert one(spark, "[[A]] x [[B|b]] [[A#h]] [[ ]] [[C\nD]]", T.wikilinks) == ["A", "B", "A", "C\nD"]


def test_hash_list(spark):
    assert one(spark, "source-hashes: [ABCDEF12, 0123456789]", T.hash_list) == ["abcdef12", "0123456789"]
    assert one(spark, "source-hashes:\n  - abcdef12\n  - 0123456789\nx: 1", T.hash_list) == ["abcdef12", "0123456789"]
    assert one(spark, "other: abcdef12", T.hash_list) is None


def test_names_and_slugs(spark):
    assert one(spark, " Foo—Bar_baz! ", T.normal_name) == "foo bar baz"
    assert one(spark, "a/b: c?", T.slug) == "a-b- c" and one(spark, "???", T.slug) == "untitled"
    assert one(spark, "Hello,  World", T.log_slug) == "hello-world" and one(spark, "", T.log_slug) == "entry"
    assert one(spark, "Don’t stop", T.kebab) == "dont-stop"
    assert one(spark, "foo-1a2b3c4-2", T.bare_title) == "foo"
    assert one(spark, "C:\\x\\my_file.pdf", T.title_of_file) == "my file"
    assert one(spark, "  a \t b ", T.topic_label) == "a b" and one(spark, "   ", T.topic_label) is None


def test_canonical_body(spark):
    assert one(spark, "a  \r\nb\n\n\n\nc \n", T.canonical_body) == "a\nb\n\nc"


def test_matching_form_folds_what_print_changes(spark):
    assert one(spark, "The ﬁrst can-\n  not “be” *so* — easy…", T.matching_form) == "the first cannot be so easy..."


def test_quotes(spark):
    t = 'He said “one two three four five” and "short" and "six seven eight nine ten".'
    assert one(spark, t, T.quoted_spans) == ["one two three four five", "six seven eight nine ten"]
    assert one(spark, "a b c ... d e [x] f g h", T.fragments) == ["a b c", "f g h"]
    assert one(spark, "One. Two! Three", T.sentences) == ["One.", "Two!", "Three"]


def test_fenced(spark):
    f = lambda c: T.fenced(c, F.lit("new"), "<!--B-->", "<!--E-->")
    assert one(spark, "x\n<!--B-->\nold\n<!--E-->\ny", f) == "x\n<!--B-->\nnew\n<!--E-->\ny"
    assert one(spark, "x\n", f) == "x\n\n<!--B-->\nnew\n<!--E-->\n"


def test_urls(spark):
    assert one(spark, "HTTPS://WWW.Example.com:443/a/?q=1#top", U.normal_url) == "https://www.example.com/a?q=1"
    assert one(spark, "http://e.com:8080/", U.normal_url) == "http://e.com:8080"
    assert one(spark, "C:\\scans\\a.pdf", U.normal_url) == "C:\\scans\\a.pdf"
    assert one(spark, "https://www.a.b.co/x", U.domain_of) == "a.b.co" and one(spark, "nothing", U.domain_of) is None
    assert one(spark, "a.b.co", U.domain_suffixes) == ["a.b.co", "b.co"] and one(spark, "localhost", U.domain_suffixes) == []
    assert one(spark, "https://e.com/a%20b/", U.slug_of_url) == "a b" and one(spark, "https://e.com/", U.slug_of_url) == "e.com"
    assert one(spark, None, U.normal_url) is None
