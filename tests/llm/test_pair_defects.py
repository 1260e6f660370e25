from __future__ import annotations

import numpy as np

from cairn.llm import pair_defects as P
from cairn.llm.crf import LinearChainCRF

CRF = P.train()
Q = "How do I keep the cache in sync with the index when the queue is full?"
CODE = "\n\n```python\ndef f(x):\n    return x\n```"


def d(answer, question=Q):
    return P.defect(CRF, question, answer)


def test_empty():
    for a in (None, "", "  ", "-", "...", "N/A", "null", "(no answer)", "​", "```python\n```", "<answer>", "<|im_end|>"):
        assert d(a) == "empty", a


def test_whole_answers():
    for a in ("Yes.", "42", "42 ms", "O(n log n)", "`cache_key`", "Call the index after each write." + CODE, "- `a`\n- `b`", "Use a lock for it.<|im_end|>", Q + "\n\nCall it after each write.", "You asked: " + Q + "\n\nCall it after each write."):
        assert d(a) is None, a


def test_refusals():
    for a in ("I'm sorry, but I can't help with that request.", "Hmm. For safety reasons I have to refuse to write that. Is there anything else?", "I must decline to answer this.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Lo siento, pero no puedo ayudar con eso.", "抱歉，我无法回答这个问题。", "As an AI model, I am not able to write this code."):
        assert d(a) == "refusal", a
    for a in ("I can't run it here, but this should do. Call it after each write." + CODE, "Sorry, the first draft was wrong: Call the index after each write.", '`x` prints "Sorry, I can\'t answer" on purpose. Call it after each write.', 'The server says "I cannot help with that" because it is full. Restart it.'):
        assert d(a) is None, a


def test_copies():
    for a in (Q, "> " + Q, "Question: " + Q, "Answer: " + Q, Q.upper(), Q + "\n" + Q, Q[:-1] + "...", Q.replace(" ", "  ")):
        assert d(a) == "copied_question", a


def test_truncated():
    for a in ("Call the index after each write. Then keep the queue", "```python\ndef f(x):\n    y = x.", "Set it to 3. When two chunks share `key`", "先检查日志的状态。然后把缓存写"):
        assert d(a, Q if "先" not in a else "如何用日志实现缓存？") == "truncated", a


def test_languages():
    german = "Das Modul schreibt den Index nur einmal am Tag. Die Suche liefert alle Treffer."
    assert d(german) == "other_language" and d(german, Q + " Please answer in German.") is None and d(german, "Wie kann ich den Index mit der Datei abgleichen?") is None
    assert d("缓存满了以后会删除最旧的条目。请先检查日志的状态。" + CODE) == "other_language"


def test_crf_learns_and_decodes():
    xs = [np.array([[1, 0], [0, 1]], float), np.array([[0, 1], [1, 0]], float)] * 5
    ys = [np.array([0, 1]), np.array([1, 0])] * 5
    m = LinearChainCRF(2, 2).fit(xs, ys, 100)
    assert m.tags(xs[0]) == [0, 1] and m.tags(xs[1]) == [1, 0]


def test_held_out_accuracy():
    import random

    rng, right, total = random.Random(99), 0, 0
    for _ in range(400):
        q, a, tags = P._sequence(rng)
        parts, x = P.features(q, a)
        if len(parts) == len(tags):
            right += sum(P.TAGS[t] == y for t, y in zip(CRF.tags(x), tags))
            total += len(tags)
    assert right / total > 0.95


def test_table(spark):
    rows = [(1, f"<|im_start|>user\n{Q}<|im_end|>\n<|im_start|>assistant\n", None, "-", None, None), (2, None, Q, None, "Fine, call it.", None), (3, None, Q, None, None, None), (4, None, None, None, None, "x"), (5, None, Q, None, None, Q)]
    df = spark.createDataFrame(rows, "rec_id long, source_text string, instruction string, target_text string, output string, response string")
    assert sorted(map(tuple, P.found(df).collect())) == [(1, "empty"), (3, "empty"), (5, "copied_question")]
    assert P.found(df.where("false")).count() == 0


def test_long_answer():
    assert d("Call the index after each write. " * 5000) is None


#: Written apart from the training parts; refusals were not used to change them (of the answers, three wrong ones led to
#: more training answers of that kind).
UNSEEN_REFUSALS = [
    "I'm not going to be able to assist you with this matter.", "That's a subject I stay away from.", "Regretfully, such content is something I don't produce.", "My rules say no to that.", "I must turn this request down.", "We don't offer help on that.", "I have decided not to give an answer here.", "It's not my place to answer this question.",
    "Being an assistant, I cannot be involved in that.", "Helping you with that would violate my policies.", "Sorry, no can do.", "I'd rather not say.", "Leider darf ich Ihnen das nicht sagen.", "Zu diesem Thema kann ich keine Antwort geben.", "Ich möchte dazu lieber nichts schreiben.", "Tut mir leid, diese Bitte muss ich ablehnen.",
    "Lo siento, esa pregunta no la puedo responder.", "No tengo permiso para hablar de ello.", "Debo rechazar lo que me pides.", "抱歉，这个我帮不了您。", "对不起，我不可以回答这类问题。", "根据规定，我不能提供相关内容。", "Désolé, il ne m'est pas permis d'en discuter.", "Je ne souhaite pas répondre à cette demande.", "Mi spiace, non mi è possibile rispondere.", "Peço desculpa, mas não posso escrever isso.",
    "Het spijt me, dat mag ik niet beantwoorden.", "Простите, я не могу об этом говорить.", "すみません、その質問にはお答えできません。", "I am sorry, but giving that explanation is not allowed for me.",
]
UNSEEN_ANSWERS = [
    "The handler must not answer twice.", "I prefer two indexes here, one by day and one by user.", "This can't be done in place; copy the list first.", "We refuse the connection when the token is old.", "Sorry for the typo above; the flag is `--all`.", "You are not allowed to write there, so change the owner of the folder.", "No help text is shown because `usage` is empty.", "It goes against the sort order, so reverse it.",
    "Der Zugriff wird abgelehnt, weil das Token fehlt.", "Das geht nicht mit einer Liste; nimm eine Menge.", "No se puede cambiar una tupla; crea otra.", "这个参数不能为空，否则会报错。", "Nothing is returned, since the filter drops every row.", "Decline the request with a 403 and log it.", "The policy allows reads only.", "I was wrong above: the limit is 20.", "Use a lock. It is not safe without one.", "Thanks for asking. Call `flush` after each write.", "The model was not trained on that column, so drop it.", "If you cannot open the port, ask for another.",
]


def test_unseen_wordings():
    found = [a for a in UNSEEN_REFUSALS if d(a) == "refusal"]
    asked = {"de": "Wie kann ich den Index mit der Datei abgleichen?", "es": "¿Cómo puedo ordenar una lista de números?", "zh": "如何用日志实现缓存？"}
    wrong = [a for a in UNSEEN_ANSWERS if d(a, asked.get(P.language(a), Q))]
    assert len(found) >= 0.9 * len(UNSEEN_REFUSALS), sorted(set(UNSEEN_REFUSALS) - set(found))
    assert len(wrong) <= 0.1 * len(UNSEEN_ANSWERS), wrong


def test_transitions_matter():
    import copy
    import random

    rng, rows = random.Random(41), []
    while len(rows) < 500:
        q, a, tags = P._sequence(rng)
        parts, x = P.features(q, a)
        if len(parts) == len(tags) > 1:
            rows.append((x, tags))
    flat = copy.deepcopy(CRF)
    flat.move[:] = 0
    wrong = lambda m: sum(P.TAGS[t] != y for x, tags in rows for t, y in zip(m.tags(x), tags))
    assert wrong(flat) > 3 * wrong(CRF) and wrong(flat) > 40


def test_other_languages_than_the_sample():
    assert d("A função devolve os resultados em ordem e grava tudo no fim. Depois disso o programa fecha o arquivo.") == "other_language"
    assert d("Il servizio legge i dati una volta al giorno e poi li scrive nella tabella.") == "other_language"
    assert d("Сервис читает данные один раз в день и записывает их в таблицу.") == "other_language"


def test_the_sample_is_bounded(spark):
    rows = [(k, None, Q, None, "Fine, call it." if k else "x" * 5000, None) for k in range(60)]
    df = P._asked(spark.createDataFrame(rows, "rec_id long, source_text string, instruction string, target_text string, output string, response string"))
    assert len(P.sample(df, n=20)) == 20 and len(P.sample(df)) == 59
