import numpy as np

from waymark.llm import language_id


def test_false_rate_is_bounded_at_any_size():
    rng = np.random.default_rng(3)
    for n in (1000, 131_073, language_id.MAX_GRAMS):
        slots = language_id.slots_for(n)
        assert slots & (slots - 1) == 0 and language_id.SLOTS <= slots <= 8 * language_id.MAX_GRAMS
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        filled = np.zeros(slots, bool)
        for k in range(language_id.HASHES):
            filled[language_id.slots_of(keys, k, slots).astype(np.int64)] = True
        assert (np.count_nonzero(filled) / slots) ** language_id.HASHES < 0.05


def corpus(spark):
    rng = np.random.default_rng(5)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "mnopqrst"))}
    rows = [(i, " ".join(rng.choice(words[lang][: 20 + i], 40)), lang) for i in range(200) for lang in words]
    return spark.createDataFrame(rows, "i int, text string, lang string")


def test_few_frequent_grams_still_tell_languages(spark):
    rows = corpus(spark)
    whole, small = language_id.fit(rows), language_id.fit(rows, max_grams=150)
    held = lambda m, i: int(np.count_nonzero(m.masks[0] & np.uint64(1 << i)))
    for i in range(3):
        assert held(small, i) <= language_id.HASHES * 150 < held(whole, i)
    assert small.masks.shape == whole.masks.shape == (1, language_id.SLOTS) and max(whole.false_rate) < 0.05
    found = language_id.predict(rows.select("i", "text", "lang"), small)
    assert found.where("lang_pred = lang").count() >= 0.98 * rows.count()
    tight = language_id.fit(rows, slots=1 << 12)
    assert tight.masks.shape == (1, 1 << 12)
    assert language_id.predict(rows, language_id.fit(rows.limit(0))).where("lang_pred <> 'und'").count() == 0
