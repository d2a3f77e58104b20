"""Small tables with the hard cases: nulls, empty and long texts, ties, repeats, clashing columns."""

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, word string, bucket int, part int, __of int, row int, node int"


def rows():
    base = "the quick brown fox jumps over the lazy dog near a quiet river bank while birds sing"
    near = base.replace("lazy", "idle")
    long_ = " ".join(f"word{i % 977} and{i % 13}," for i in range(9000)) + "\n" + "x" * 5000
    texts = [
        base, base, near, None, "", "   \n\t ", "!!! ??? 123", "é à ü ñ café naïve façade über", "one", "two words",
        f"{base}\n{base}\nshort\n{near} today", long_, "a b　c  d \n e", "İstanbul ΣΑΣ ſ ﬁ é", "<|endoftext|> don't we'll I'd",
        "\\### <turn>user\n</turn> \\<turn>", base.upper(), "tab\tsep\x0bvt\x0cff\x1cfs\x85nel\r\nend ", "日本語 テキスト 你好", "\U0001f600 smile",
    ]
    out = [(i, t, ("en", "fr", "de", None)[i % 4], "s", len(t or ""), "k", "w", 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    out.append((19, texts[19], "en", "s", 1, None, None, None, None, None, None, None))  # a repeated row
    out.append((None, "a text without an id and a few words more", None, None, None, None, None, None, None, None, None, None))
    return out


def table(spark, empty=False):
    return spark.createDataFrame([] if empty else rows(), DDL)
