"""Encodings told by likelihood, and text files read in them."""

import random

import pytest

from sievewright.functions import encodings as E
from sievewright.sources import files

TEXTS = {
    "gb18030": ["名字,城市\n张三,北京\n", "人民日报社论：经济发展与社会进步，科学技术是第一生产力。\n姓名,电话", "李四,上海,2024-01-01,100"],
    "big5": ["姓名,城市\n王小明,臺北\n", "國家發展委員會今日公布最新經濟數據，顯示景氣持續回升。", "訂單編號,客戶名稱\n1001,陳先生"],
    "shift_jis": ["名前,住所\n山田太郎,東京都\n", "これは日本語のテキストです。カタカナもあります。", "商品コード,商品名\n1,りんご"],
    "euc_jp": ["これは日本語のテキストです。カタカナもあります。"],
    "euc_kr": ["이름,도시\n홍길동,서울\n", "대한민국의 경제는 계속 성장하고 있습니다."],
    "cp1252": ["nom,ville\nRené,Orléans\n", "L'été dernier, nous avons visité la forêt. Où êtes-vous allés?", "Müller,Köln\nGroß,Düsseldorf\n", "señor,año\nniño,mañana\n"],
    "cp1251": ["имя,город\nИван,Москва\n", "Экономика страны продолжает расти."],
}


@pytest.mark.parametrize(("encoding", "text"), [(e, t) for e, ts in TEXTS.items() for t in ts])
def test_heads_are_told_apart(encoding, text):
    assert E.sniffed(text.encode(encoding)) == encoding


def test_cut_heads():
    """The last character of a head may be cut in two."""
    for encoding, texts in TEXTS.items():
        raw = (texts[-1] * 5).encode(encoding)
        for end in range(len(raw) - 4, len(raw)):
            assert E.sniffed(raw[:end]) == encoding
    assert {E.sniffed("a,名字\n".encode()[:n]) for n in (3, 4, 5, 6, 7)} == {"utf-8"}
    assert E.sniffed("名字".encode()[:2] + b"a" + "字".encode()) != "utf-8"


def test_generated_text_of_common_characters():
    """Random sequences of a set's common characters, with figures and commas between them, by 40 bytes or so: at most one in fifty is taken for another set."""
    draw = random.Random(2)
    for encoding in ("gb18030", "big5", "shift_jis", "euc_kr"):
        rows, wrong = E.ROWS[encoding], 0
        kana = [c for first, last, low, high, _ in rows[: 3 if encoding == "shift_jis" else 1] for lead in range(first, last + 1) for trail in range(low, high + 1) if len(c := bytes([lead, trail]).decode(encoding, "ignore")) == 1]
        for _ in range(100):
            text = "".join(draw.choice(kana) if draw.random() < 0.8 else draw.choice("0123456789,\n") for _ in range(25))
            wrong += E.sniffed(text.encode(encoding)) != encoding
        assert wrong <= 2, encoding


def test_marks_and_nul_bytes():
    for name in ("utf-8-sig", "utf-16", "utf-32"):
        assert E.sniffed("a,b\n1,2\n".encode(name)) == name
    assert E.sniffed("a,b\n1,2\n".encode("utf-16-le")) == "utf-16-le" and E.sniffed("a,b\n1,2\n".encode("utf-16-be")) == "utf-16-be"
    assert E.sniffed(b"") == E.sniffed(b"plain") == "utf-8"


def test_pages():
    han, french = TEXTS["gb18030"][1], TEXTS["cp1252"][1]
    assert E.page_text(han.encode("gbk")) == han and E.page_text(french.encode("cp1252"), "text/html; charset=iso-8859-1") == french
    assert E.page_text(b'<meta charset="euc-jp">' + "漢字".encode("euc_jp")).endswith("漢字")
    assert E.page_text(han.encode(), "text/html; charset=big5") == han  # what is said does not decode
    assert E.page_text("<?xml version='1.0' encoding='gb2312'?>镕".encode("gbk")).endswith("镕")  # the superset stands for it
    assert E.page_text(b"\xff\xff\xff") and E.page_text(b"", "charset=nonsense") == ""
    assert E.named(b"", "x; charset=Windows-1251") == ["cp1251"]


@pytest.mark.parametrize("encoding", ["gb18030", "big5", "shift_jis", "cp1252", "cp1251", "utf-32"])
def test_files_in_an_encoding(spark, tmp_path, encoding):
    text = TEXTS.get(encoding, TEXTS["big5"])[0]
    (tmp_path / "a.csv").write_bytes(text.encode(encoding))
    got = files.read_csv(spark, [files.Input("a.csv", f"file://{tmp_path}/a.csv", 0)])
    lines = [line.split(",") for line in text.split("\n") if line]
    assert got.columns[:2] == lines[0] and [list(r[:2]) for r in got.orderBy("_row").collect()] == lines[1:]
