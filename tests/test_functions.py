import math

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import build, digests, documents, paths, properties, text
from corpuslens.operators import classify


def test_chunk_golden_value(value_of):
    assert value_of(digests.chunk_set(F.lit("ABCDEFG"))) == [348169375744]
    assert value_of(digests.chunk_set(F.lit("ABCDEF"))) == []


def test_digest_parts_collapse_runs(value_of):
    first, second = digests.digest_parts(F.lit("96:ABBBBBBC:DDDDE"))
    assert value_of(first, second) == ("ABBBC", "DDDE")
    assert value_of(digests.digest_block_size(F.lit("96:A:B"))) == 96


@pytest.mark.parametrize(
    "path, expected",
    [("/a//b/./c/../d", "/a/b/d"), (" /x/ ", "/x"), ("../../a/..", "../.."), ("/../x", "/x"), ("a/..", ".")],
)
def test_normalize_path(value_of, path, expected):
    assert value_of(paths.normalize_path(F.lit(path))) == expected


def test_path_functions(value_of):
    assert value_of(paths.parent_name(F.lit("/r/a/f.txt"), F.lit("/r"))) == "a"
    assert value_of(paths.parent_name(F.lit("/r/f.txt"), F.lit("/r"))) == "/"
    assert value_of(paths.path_prefixes(F.lit("/a/b/c.txt"))) == ["/a", "/a/b"]
    assert value_of(paths.path_prefixes(F.lit("/c.txt"))) == []
    assert value_of(paths.drop_marked_segments(F.lit("/a/x.zip_extract/b"))) == "/a/b"
    assert value_of(paths.subfolders_after(F.lit("/s/system/lib/hw/f.so"), F.lit("system"))) == ["lib", "hw"]
    assert value_of(paths.subfolders_after(F.lit("system/lib/f.so"), F.lit("system"))) == []
    assert value_of(paths.subfolders_after(F.lit("/s/lib/f.so"), F.lit("system"))) == []
    assert value_of(paths.replace_last(F.lit("a.b.c"), ".", "$1")) == "a.b$1c"


VENDOR_CASES = [
    ({"ro_product_manufacturer": "samsung", "ro_product_brand": "samsung"}, "Samsung"),
    ({"ro_product_manufacturer": "Google", "ro_build_fingerprint": "google/redfin/redfin:11/x"}, "Google"),
    ({"ro_product_manufacturer": "LG Electronics", "ro_product_brand": "lge"}, "LG"),
    ({"ro_build_fingerprint": "xiaomi/raphael/raphael:10/x"}, "Xiaomi"),
    ({"ro_product_manufacturer": "SomeUnknownVendor", "ro_product_brand": "unknownbrand"}, "SomeUnknownVendor"),
    ({"ro_build_version_release": "11", "ro_build_version_security_patch": "2021-01-01"}, None),
    ({}, None),
    ({"ro_product_manufacturer": "samsung", "ro_product_brand": "different_brand"}, "Samsung"),
    ({"ro_product_manufacturer": "SAMSUNG", "ro_product_brand": "Samsung"}, "Samsung"),
    ({"ro_product_manufacturer": "Unknown", "ro_product_brand": "nokia"}, "Nokia"),
]


@pytest.mark.parametrize("values, expected", VENDOR_CASES)
def test_vendor_of_file(spark, values, expected):
    df = spark.createDataFrame([(values,)], "properties map<string,string>")
    assert df.select(properties.vendor_of_file("properties")).first()[0] == expected


@pytest.mark.parametrize(
    "release, expected", [("11", 11), ("8.1.0", 8), ("Tiramisu", 0), ("", None), (None, None)]
)
def test_version_of_file(spark, release, expected):
    df = spark.createDataFrame([({"ro_build_version_release": release},)], "properties map<string,string>")
    assert df.select(properties.version_of_file("properties")).first()[0] == expected


def test_parse_properties(value_of):
    lines = F.split(F.lit("ro.a=1\nb=2\nro.a=3  \n#k=v\nq=1=2\nplain\n@import x"), "\n")
    assert value_of(properties.parse_properties(lines)) == {"ro_a": "3", "b": "2", "#k": "v"}
    assert "error" in value_of(properties.parse_properties(F.array(F.lit("nothing"))))


def test_entropies(value_of):
    found = value_of(text.entropies(F.lit("aabé")))
    assert found["shannon_entropy"] == pytest.approx(1.5)
    assert found["natural_entropy"] == pytest.approx(1.5 * math.log(2))
    assert found["hartley_entropy"] == pytest.approx(1.5 * math.log10(2))
    assert value_of(text.entropies(F.lit("")))["shannon_entropy"] == 0.0
    assert value_of(text.entropies(F.lit("aaaa")))["shannon_entropy"] == pytest.approx(0.0)


def test_url_parts_and_flags(value_of):
    parts = text.url_parts(F.lit("http://h.com/a;p?q=1#f"))
    assert value_of(*parts.values()) == ("http", "h.com", "/a", "p", "q=1", "f")
    cases = {"12.5": "isNumeric", "http://a.b/c": "isURL", "/etc/passwd": "isFilePath", "select a from b ": "isSQLStatement",
             "QUJDREVGR0hJSktMTU5PUA==": "isEncoded", "api_key = 'abcdefgh1'": "isSecret", "???": "isUnknownCategory"}
    for value, flag in cases.items():
        assert value_of(text.text_flags(F.lit(value))[flag]), value


def test_language(value_of):
    assert value_of(text.language(F.lit("Der Hund und die Katze")))["language_code"] == "de"
    assert value_of(text.language(F.lit("xyz")))["language_code"] is None


def test_storable_keys(value_of):
    assert value_of(documents.storable_key(F.lit("$$a.b"))) == "???a???b"
    assert value_of(documents.list_of_scalar_or_list(F.lit("7"))) == [7]
    assert value_of(documents.list_of_scalar_or_list(F.lit("[7, 8]"))) == [7, 8]


def test_build_functions(value_of):
    assert value_of(build.module_name(F.lit("lib a-b@1.so"), "_x")) == "lib_a_b_1_so_x"
    assert value_of(build.render_template("A $$(X) ${n}!", {"n": F.lit("v")})) == "A $(X) v!"
    with pytest.raises(KeyError):
        build.render_template("${missing}", {})
    assert value_of(build.signing_key(F.lit("android.uid.media"), F.lit("p"))) == "media"
    assert value_of(build.signing_key(F.lit(None), F.lit("com.networkstack.x"))) == "networkstack"
    assert value_of(build.signing_key(F.lit("android.uid.system"), F.lit(None))) == "platform"
    assert value_of(build.meta_group(F.lit("My_ODM"))) == "vendor"


@pytest.mark.parametrize(
    "directory, expected",
    [("SystemUIGoogle", "SystemUI"), ("Camera2", "Camera2"), ("Camera2Google", ""), ("SettingsOverlay", ""), ("x Tag", "Tag")],
)
def test_app_override(value_of, directory, expected):
    assert value_of(classify.app_override(F.lit(directory))) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("system.img", ["system"]), ("._system.img", []), ("system_other.img", ["system_other"]), ("vbmeta.img", []),
        ("VENDOR.IMG", ["vendor"]), ("my_ext.img", ["custom_ext"]), ("system_ext.img", ["system_ext"]),
        ("super_empty.img", ["super_empty"]), ("system.patch.dat", []),
    ],
)
def test_image_labels(value_of, name, expected):
    found = value_of(classify.image_labels(F.lit(name), F.lit(False)))
    assert [label for label in found if label != "super"] == [label for label in expected if label != "super"]
    assert value_of(classify.image_labels(F.lit(name), F.lit(True))) == []
