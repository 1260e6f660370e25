"""Language of prose: by script, by function words, and by letter trigrams where those say too little."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and is are was be been of to that it its in for on with not no you your we our they he she this these those but when each by which then do does did how what why who has have had can cannot could should would will may one than from as at or if i me my so there here before after until between into only more please write explain".split(),
    "de": "der die das den dem des und ist sind war wird werden ein eine einen einem einer eines nicht mit nach sobald wenn mehr als ob noch wie kann ich sie wir er es zu zum zur auf für von vom im ist bei hat haben nur bitte zuerst warum was wer dabei aber mir leid kein keine keinen damit muss so jeden jede schreibe zwischen einmal am".split(),
    "es": "el la los las un una unos unas de del que y en con para por se es son no más al si pero lo ha han hay cuando una vez cada día solo otro otra está todavía primero cómo qué puedo como su sus ese eso me nos este esta entre sobre escribe tan siento".split(),
    "fr": "le la les un une des du de et est sont était être que qui ne pas plus pour dans avec sur par il elle nous vous ils je tu on se ce cette ces mais ou où donc si au aux comme tout très peut faire été leur son sa ses votre notre quand chaque avant après sans".split(),
    "it": "il lo la gli le un uno una di del della dei delle e è sono era che non più per con su da nel nella si ma anche come quando se questo questa questi quello ogni prima dopo può deve essere stato ho ha hanno mi ti ci loro suo sua solo così".split(),
    "pt": "o os as um uma uns de do da dos das e é são era que não mais para por com em no na nos nas se mas como quando cada este esta isso seu sua você ele ela eles nós pode deve ser foi há já muito também só antes depois até sem ao à".split(),
    "nl": "de het een en is zijn was van dat die niet met voor op aan te om er maar ook als bij naar uit dan nog wel geen wordt worden kan moet heeft hebben ik je wij ze hij deze dit elke eerst na door over of zo".split(),
}
#: Short texts of each language, for its trigrams.
SAMPLES = {
    "en": "The table is kept until the next request comes in, and the rows which are older than a day will be removed. You should check whether the file exists before you open it, because there might be nothing to read.",
    "de": "Die Tabelle bleibt erhalten, bis die nächste Anfrage kommt, und ältere Zeilen werden gelöscht. Sie sollten prüfen, ob die Datei vorhanden ist, bevor Sie sie öffnen, denn vielleicht gibt es nichts zu lesen.",
    "es": "La tabla se conserva hasta que llega la siguiente petición, y las filas más antiguas se borran. Debería comprobar si el archivo existe antes de abrirlo, porque quizá no haya nada que leer en esta dirección.",
    "fr": "La table est conservée jusqu'à la prochaine requête, et les lignes plus anciennes sont supprimées. Vous devriez vérifier que le fichier existe avant de l'ouvrir, car il se peut qu'il n'y ait rien à lire.",
    "it": "La tabella viene conservata fino alla prossima richiesta, e le righe più vecchie vengono eliminate. Dovresti controllare che il file esista prima di aprirlo, perché potrebbe non esserci niente da leggere.",
    "pt": "A tabela é mantida até que chegue o próximo pedido, e as linhas mais antigas são apagadas. Você deveria verificar se o arquivo existe antes de abrir, porque talvez não haja nada para ler nesta informação.",
    "nl": "De tabel blijft bewaard tot het volgende verzoek komt, en oudere rijen worden verwijderd. U moet controleren of het bestand bestaat voordat u het opent, want misschien is er niets te lezen.",
}
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
#: Languages told by their script alone.
SCRIPTS = {"ja": r"[぀-ヿ]", "ko": r"[가-힯ᄀ-ᇿ]", "ru": r"[Ѐ-ӿ]", "ar": r"[؀-ۿ]", "el": r"[Ͱ-Ͽ]", "he": r"[֐-׿]", "hi": r"[ऀ-ॿ]", "th": r"[฀-๿]"}
_SCRIPTS = {k: re.compile(v) for k, v in SCRIPTS.items()}
_ODD = re.compile(r"[Ͱ-῿぀-ヿ가-힯]")
_CJK = re.compile(r"[㐀-䶿一-鿿]")
_WORD = re.compile(r"[^\W\d_㐀-䶿一-鿿]+")
#: Words from which trigrams may decide, and by how much a letter must favour the language.
LEAST_WORDS, LEAST_MARGIN = 5, 0.12


@cache
def _trigrams() -> dict[str, dict[str, float]]:
    out = {}
    for lang, words in FUNCTION_WORDS.items():
        counts: Counter = Counter()
        for w in [*words, *words, *_WORD.findall(SAMPLES[lang].lower())]:
            counts.update(f" {w} "[k : k + 3] for k in range(len(w)))
        total = sum(counts.values())
        out[lang] = {g: math.log((n + 0.3) / (total + 600)) for g, n in counts.items()} | {"": math.log(0.3 / (total + 600))}
    return out


def by_trigrams(words: list[str]) -> tuple[str, float]:
    """The likeliest language of words, and how far a trigram is likelier in it than in the next, on average."""
    grams = [f" {w} "[k : k + 3] for w in words for k in range(len(w))]
    score = {lang: sum(t.get(g, t[""]) for g in grams) / max(1, len(grams)) for lang, t in _trigrams().items()}
    first, second = sorted(score, key=score.get, reverse=True)[:2]
    return first, score[first] - score[second]


def language(text: str) -> str | None:
    """A language's short name; None where nothing tells."""
    han = len(_CJK.findall(text))
    words = _WORD.findall(text.lower())
    if _ODD.search(text):
        counts = {k: len(rx.findall(text)) for k, rx in _SCRIPTS.items()}
        best = max(counts, key=counts.get)
        if counts[best] >= 3 and counts[best] * 4 > han + sum(map(len, words)):
            return best
    if han >= 3 and han * 2 > len(words):
        return "zh"
    score = {k: sum((len(w) > 1) + 0.5 * (len(w) == 1) for w in words if w in s) for k, s in _SETS.items()}  # a letter alone is often a name
    best = max(score, key=score.get)
    ranked = sorted(score.values())
    if score[best] >= 1 and ranked[-1] > ranked[-2]:
        return best
    if len(words) >= LEAST_WORDS:
        likely, margin = by_trigrams(words)
        if margin >= LEAST_MARGIN and score[likely] == ranked[-1]:
            return likely
    return None


#: Names of the languages in each other.
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|ingl[eé]s|anglais|inglese|英语|英文", "de": r"german|deutsch\w*|alem[aáã]\w*|allemand|tedesco|德语|德文", "es": r"spanish|spanisch\w*|español|castellano|espagnol|spagnolo|espanhol|西班牙语|西班牙文", "zh": r"chinese|mandarin|chinesisch\w*|chino|mandarín|chinois|中文|汉语|漢語|普通话",
    "fr": r"french|französisch\w*|francés|français|francese|francês|法语|法文", "it": r"italian|italienisch\w*|italiano|italien|意大利语", "pt": r"portuguese|portugiesisch\w*|portugués|portugais|português|葡萄牙语", "nl": r"dutch|niederländisch\w*|neerlandés|néerlandais|荷兰语", "ru": r"russian|russisch\w*|ruso|russe|俄语", "ja": r"japanese|japanisch\w*|japonés|japonais|日语|日文", "ko": r"korean|koreanisch\w*|coreano|coréen|韩语",
}
_NAMED = {k: re.compile(v, re.I) for k, v in LANGUAGE_NAMES.items()}


def asked_for(question: str) -> set[str]:
    """Languages that the question names."""
    return {k for k, rx in _NAMED.items() if rx.search(question)}
