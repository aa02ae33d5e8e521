import pytest

from tracebed.llm.garbled import Alphabet, best_path, damaged_documents, readings, restored_documents

CLEAN = {
    "es": "Según el diseño, la configuración no está vacía y después se omitió la excepción más pequeña del señalador.",
    "de": "Die Prüfung läuft über mehrere Stunden und bricht danach für größere Schäden gültig ab.",
    "ru": "Проверка файла завершена, повторный запуск не изменил отпечаток записи.",
    "pl": "Następny wątek porówna ścieżkę żądań, sprawdź błąd i zgłoś użytkownik.",
    "ja": "この規則は外部入力にのみ適用されます。検査は警告で終了しました。",
    "en": "It’s a “partial” result – the café façade stays naïve; costs are €20 … nobody noticed.",
    "el": "Η συνάρτηση καλείται δύο φορές και ο έλεγχος ολοκληρώθηκε.",
    "zh": "术语表：扫描、规则、基线、指纹、冒烟、茅屋、卤素、拢共、漏洞",
}
PAIRS = [("es", "utf-8", "cp1252"), ("es", "utf-8", "mac_roman"), ("es", "utf-8", "cp437"), ("de", "cp850", "latin-1"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "cp1251"), ("pl", "cp1250", "cp1252"), ("el", "utf-8", "gb18030"), ("ja", "utf-8", "latin-1")]


@pytest.fixture(scope="module")
def corpus():
    return [(i, t) for i, t in enumerate(t for t in CLEAN.values() for _ in range(12))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id bigint, text string, piece string, pos int")


def test_damaged_documents_are_found_and_restored(spark, corpus):
    bad, want = [], {}
    for k, (lang, written, read) in enumerate(PAIRS):
        text = CLEAN[lang].encode(written, "replace").decode(read, "replace")
        if "�" in text:
            continue
        bad.append((1000 + k, f"Start. {text}\nEnd."))
        want[1000 + k] = f"Start. {CLEAN[lang]}\nEnd."
    twice = CLEAN["en"].encode().decode("cp1252", "replace").encode("utf-8").decode("cp1252", "replace")
    bad += [(2000, twice), (2001, CLEAN["de"].encode("ascii", "replace").decode()), (2002, CLEAN["es"].encode().decode("ascii", "replace"))]
    assert len(want) >= 8
    docs = table(spark, corpus + bad + [(3000, None), (3001, ""), (3002, "plain"), (None, "Ã©"), (3003, "x" * 100_000)])
    found = {r.doc_id for r in damaged_documents(docs).collect()}
    assert found == {*want, 2000, 2002}
    restored = {r.doc_id: (r.restored, r.n_open) for r in restored_documents(docs).collect()}
    assert {k: restored[k][0] for k in want} == want
    assert restored[2002][0] == CLEAN["es"]


def test_readings():
    assert ("cp437>utf-8", "élément") in readings("├⌐l├⌐ment")
    assert ("gb18030>utf-8", "façade") in readings("fa莽ade")
    assert ("cp1252>utf-8 cp1252>utf-8", "‘render") in readings("Ã¢â‚¬Ëœrender")
    assert "…" in {r for _, r in readings("鈥�")}


def test_any_number_of_lost_bytes_stays_open():
    # cp1252 has no character for 81, 8D, 8F, 90 and 9D: a reading fills these and no others
    broken = "Ïàïüýíÿ".encode().decode("cp1252", "replace")
    assert broken.count("�") >= 1 and "Ïàïüýíÿ" in {r for _, r in readings(broken)}
    both = {r for _, r in readings("Ã�Ã�")}
    assert {"ÁÁ", "ÍÏ", "ÐÝ"} <= both and not any("Ó" in r or "Ä" in r for r in both)
    assert {r[1:] for _, r in readings("â€�") if len(r) == 2} == set() and "”" in {r for _, r in readings("â€�")}
    assert "’" not in {r for p, r in readings("â€�") if p == "cp1252>utf-8"}


def test_the_search_inside_a_piece_is_guided_by_the_corpus(spark):
    text = "ненастная ясная погода с яркими листьями"
    broken = text.encode().decode("cp1252", "replace")
    alphabet = Alphabet({c: 5.0 for c in text if ord(c) > 127})
    word = broken.split(" ")[1]
    assert word.count("�") >= 2 and text.split(" ")[1] in {r for _, r in readings(word, alphabet)}
    docs = table(spark, [(i, t) for i, t in enumerate([text + f" {k}" for k in range(30)])] + [(99, broken)])
    got = {r.doc_id: r for r in restored_documents(docs).collect()}
    lost = sum("�" in w for w in broken.split(" "))
    assert set(got) == {99} and got[99].restored == text and got[99].n_open == got[99].n_guessed == lost


def test_what_nothing_can_restore_stays_open(spark, corpus):
    got = {r.doc_id: (r.restored, r.n_open, r.n_guessed) for r in restored_documents(table(spark, corpus + [(99, "x zq�����vw y")])).collect()}
    assert got == {99: ("x zq�����vw y", 1, 0)}


def test_path_prefers_text_as_it_stands():
    weak = [{"pos": 0, "options": [{"pair": "a", "gain": 3.0, "reading": "x"}]}]
    assert best_path(weak) == (0.0, {})
    run = [{"pos": i, "options": [{"pair": "a", "gain": 4.0, "reading": f"x{i}"}, {"pair": "b", "gain": 4.5 if i == 1 else 0.5, "reading": "y"}]} for i in range(4)]
    score, found = best_path(run)
    assert found == {i: f"x{i}" for i in range(4)} and score > 0


def test_empty_and_repeated(spark, corpus):
    assert damaged_documents(table(spark, [])).count() == 0
    bad = (1, "Está vacía".encode().decode("cp1252") + " configuraciÃ³n despuÃ©s")
    assert [r.doc_id for r in damaged_documents(table(spark, corpus[12:] + [(100 + i, t) for i, t in corpus] + [bad, bad])).collect()] == [1]


def test_copies_of_a_damaged_text_are_a_third_of_all_rows(spark):
    # 200 different texts; the true words stand in a few of them
    clean = [(i, f"La configuración número {i} no cambia." if i < 4 else f"Plain text number w{i} stands here.") for i in range(200)]
    bad = [(1000 + i, "La configuraciÃ³n no cambia.") for i in range(100)] + [(2000, "Otra configuraciÃ³n.")]
    assert {r.doc_id for r in damaged_documents(table(spark, clean + bad)).collect()} == {i for i, _ in bad}
    restored = {r.doc_id: r.restored for r in restored_documents(table(spark, clean + bad)).collect()}
    assert restored[1000] == "La configuración no cambia." and restored[2000] == "Otra configuración."
