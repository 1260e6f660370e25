"""Texts of which training sequences for pair defects are composed: parts of sentences by language, to be combined."""

from __future__ import annotations

import random

QUESTIONS = {
    "en": ["How do I sort a list of numbers in place?", "Write a function `merge` that joins two maps.", "Explain why the parser is slow for large files.", "What is the difference between a thread and a process?", "Can you show me how to read this file?", "Design a service that keeps 20 records a second."],
    "de": ["Wie kann ich die Datei mit dem Index abgleichen?", "Schreibe eine Funktion, die jeden Eintrag zählt.", "Warum ist die Suche so langsam?", "Was macht dieser Dienst genau?"],
    "es": ["¿Cómo puedo ordenar una lista de números?", "Escribe una función que busque cada archivo.", "¿Por qué es tan lenta la búsqueda?", "¿Qué hace este módulo?"],
    "zh": ["请解释线程和进程之间的区别。", "如何实现一个带上限的缓存？", "为什么这个查询这么慢？", "请写一个函数来统计行数。"],
    "fr": ["Comment trier une liste de nombres ?", "Écris une fonction qui compte les lignes."],
    "pt": ["Como posso ordenar uma lista?", "Escreva uma função que conte as linhas."],
}
ANSWERS = {
    "en": [
        "Call `sort` on the list.", "The loop runs once for each of the 20 items.", "This keeps the order of equal keys.", "You can pass a limit to `merge` and it is kept.", "It helps to log the size before the call.", "A cache without a limit grows until the memory is gone.",
        "The server cannot open this file, so it answers with an error.", "You can't pass None here.", "It would not be safe to share the lock.", "The user is not allowed to write to this table unless the flag is set.", "I would use a queue instead of a lock.", "I think the index is missing.", "We moved the pool so that each worker owns one queue.",
        "If the call fails twice, the request is refused and the entry is skipped.", "That is outside the range of the array, so it raises.", "Set the policy to `deny` and the guidelines are shown again.", "This topic is covered by the reader, which needs no permission.", "My version of the code declines every second request.", "Do not send a 200 here; an empty body needs 204.", "There is no function of that name; write a map instead.", "Sadly this call is slow; cache what it returns.", "You must not call it twice, or the entry is lost.", "Unfortunately the flag was removed in 3.2; pass a list.", "Never answer before the lock is free.", "It is not possible to change a tuple, so build a new one.", "No, the order does not matter.", "A worker may not block the queue.", "This class was not designed for threads, so lock it.", "The parser must not run before the reader.", "The table was built without a key.", "I prefer a map over a list for this.", "We drop a request when its key is stale.", "I would rather use two locks, one for each queue.", "We decline such calls in the proxy.", "We won't see the change until the cache is cleared.", "I keep the old rows in one table, by month.", "The reader was not built for that format, so convert it.", "Our tests do not cover the parser yet.", "Such a request gets no reply unless the port is open.", "Please check the log before you answer the next one.",
    ],
    "de": ["Der Index wird nach jeder Änderung neu geladen.", "Die Funktion liefert alle Treffer und sortiert sie.", "Bitte prüfen Sie zuerst, ob die Datei noch da ist.", "Der Dienst kann die Datei nicht öffnen und meldet einen Fehler.", "Ohne Erlaubnis darf der Nutzer nichts schreiben.", "Die Anfrage wird dann abgelehnt."],
    "es": ["La función devuelve los resultados en orden.", "Si no existe un archivo, el programa crea otro.", "El índice se carga una vez al día.", "El servicio no puede abrir el archivo y avisa.", "La petición se rechaza si el usuario no tiene permiso."],
    "zh": ["线程共享内存，进程不共享。", "缓存满了以后会删除最旧的条目。", "请先检查日志的状态。", "服务无法打开这个文件，所以返回错误。", "如果没有权限，请求会被拒绝。", "主键不能重复，不然写入会失败。", "这里不可以使用全局变量。", "数值不能小于零，不然会抛出异常。", "列表不能为空。"],
    "fr": ["La fonction renvoie les lignes dans l'ordre.", "Le service ne peut pas ouvrir le fichier et le signale.", "Il suffit d'appeler la méthode après chaque écriture."],
    "pt": ["A função devolve as linhas em ordem.", "O serviço não pode abrir o arquivo e avisa.", "Basta chamar o método depois de cada escrita."],
    "it": ["La funzione restituisce le righe in ordine.", "Il servizio legge il file una volta al giorno.", "Basta chiamare il metodo dopo ogni scrittura."],
    "nl": ["De functie geeft de rijen op volgorde terug.", "De dienst leest het bestand elke dag.", "Roep de methode na elke wijziging aan."],
    "ru": ["Функция возвращает строки по порядку.", "Сервис читает файл один раз в день."],
    "ja": ["この関数は行を順番に返します。", "サービスは一日に一回ファイルを読みます。"],
}
_OPEN = ["", "", "I'm sorry, but ", "Sorry, ", "I apologize, but ", "Unfortunately, ", "Regrettably, ", "Sadly ", "Sadly, ", "Alas, ", "I regret that ", "I'm afraid ", "As an AI, ", "As a language model, ", "For safety reasons ", "For legal reasons, ", "To stay within policy, ", "Thank you for asking, but ", "I understand, however "]
_WHO = ["I", "we", "this assistant"]
_CANT = ["can't", "cannot", "am not able to", "am unable to", "won't", "will not", "must decline to", "have to refuse to", "am not permitted to", "may not", "would rather not", "prefer not to", "'d prefer not to", "decline to", "refuse to", "do not feel comfortable enough to", "am not in a position to", "choose not to", "should not"]
_DO = ["help", "assist", "help you", "answer", "provide", "write", "discuss", "share", "explain", "comment on", "go into", "continue with", "do", "give", "support", "talk about", "fulfil", "complete", "respond to", "engage with", "be of any help with", "take part in", "go along with", "cover", "work on", "say more about", "produce", "deal with", "process"]
_IT = ["that", "this", "that request", "this topic", "your question", "such things", "it", "the code you describe", "what you ask for", "anything of that kind", "code for that", "code for this part", "code for the lock", "the code of that module", "details of the table", "anything on the cache", "how the pool works", "anything about it", "an implementation", "such an implementation", "the code", "this kind of request", "details about that", "an answer", "that here", "this subject", "any of it"]
_NOMINAL = [
    "{0}this goes against my {1}.", "{0}that is outside of what I {2}.", "{0}this falls outside the scope of what I {2}.", "{0}that is beyond what I {2}.", "{0}it isn't possible for me to {3} {4}.", "{0}that's not something I {2}.", "{0}my {1} do not allow me to {3} {4}.", "{0}my {1} prevent me from this.",
    "{0}answering {4} would be inappropriate.", "{0}it would be wrong of me to {3} {4}.", "{0}I have no answer to give on {4}.", "{0}there is nothing I can say about {4}.", "{0}I'll have to pass on {4}.", "{0}I must keep silent on {4}.", "{0}this request has been declined.", "{0}your request cannot be fulfilled by me.", "{0}no answer can be given to {4}.",
    "{0}I was not {5} to {3} {4}.", "{0}providing {4} is against my {1}.", "{0}helping with {4} is something I avoid.", "{0}please don't ask me about {4}.", "{0}it is not appropriate for me to {3} {4}.", "{0}that lies outside my {6}.", "{0}this is not within my {6}.", "{0}{7} would not be right.", "{0}{7} would be {8}.", "{0}{7} would break my {1}.", "{0}{7} is {8}.", "{0}my {1} rule that out.", "{0}the {1} I follow forbid it.", "{0}it is against the {1} I was given.",
    "{0}such things are off limits for me.", "{0}I'm going to say no to that.", "{0}no.", "Not something I will {3}.", "Not going to {3} {4}.", "{0}I won't be {7} {4}.", "{0}let us not {3} {4}.", "{0}I'd sooner not {3} {4}.", "{0}I leave {4} unanswered.", "{0}I have been told not to {3} {4}.", "{0}I abstain from {7} {4}.", "No comment on {4}.", "{0}you will get no answer to {4} from me.",
]
_RULES, _ABLE, _MADE, _FIELD = ["guidelines", "policies", "rules", "principles", "instructions", "programming"], ["am allowed to do", "can help with", "am able to do", "am permitted to answer", "may discuss", "assist with", "am comfortable with", "can share", "do"], ["designed", "trained", "built", "made"], ["remit", "abilities", "competence", "area", "scope", "role"]
_SINCE = ["", "", "", "", " here", ", since it might be misused", " because it could do harm", ", as this may be abused", " for reasons of safety", ", and I ask for your understanding", " at all", " under any circumstances"]
_DOING = ["answering", "helping", "sharing this", "writing this", "explaining it", "discussing that", "giving details", "doing so", "providing code for that"]
_WRONG = ["inappropriate", "irresponsible", "unethical", "improper", "against the rules", "out of the question", "not acceptable", "unsafe", "a breach of trust", "not allowed"]
#: Openings, ways to decline and what is declined, by language; all are combined.
_OTHER = {
    "de": (["", "Es tut mir leid, aber ", "Leider ", "Tut mir leid, ", "Als Sprachmodell ", "Bedaure, "], ["kann ich {}", "darf ich {}", "möchte ich {}", "will ich {}", "werde ich {}", "bin ich nicht in der Lage, {}", "ist es mir nicht gestattet, {}", "ist es mir nicht möglich, {}", "lehne ich es ab, {}", "muss ich es ablehnen, {}", "sehe ich mich nicht imstande, {}", "verzichte ich darauf, {}"], ["dabei nicht zu helfen", "dazu nichts zu sagen", "diese Frage nicht zu beantworten", "das nicht zu erklären", "diesen Code nicht zu schreiben", "hier nicht weiterzuhelfen", "darüber zu sprechen", "das zu schreiben", "so etwas zu teilen", "dabei nicht helfen", "das nicht beantworten", "dazu nichts sagen", "diesen Code nicht schreiben", "darauf nicht antworten", "keine Auskunft geben", "keine Hilfe leisten"]),
    "es": (["", "Lo siento, pero ", "Lamentablemente, ", "Lo lamento, ", "Como modelo de lenguaje, ", "Me temo que ", "Disculpe, "], ["no puedo {}", "no me es posible {}", "debo negarme a {}", "no estoy autorizado a {}", "prefiero no {}", "va en contra de mis normas {}", "no voy a {}", "me niego a {}", "no me está permitido {}", "no me corresponde {}", "tengo que rechazar {}", "me abstengo de {}"], ["ayudar con eso", "responder a esta pregunta", "contestar", "compartir eso", "hablar de este tema", "escribir ese código", "proporcionar esa información", "dar detalles", "continuar con esto", "colaborar", "explicarlo", "hacer tal cosa"]),
    "zh": (["", "抱歉，", "对不起，", "很遗憾，", "不好意思，", "作为一个语言模型，", "非常抱歉，"], ["我无法{}", "我不能{}", "我不便{}", "我不会{}", "我拒绝{}", "恕我不能{}", "我没有办法{}", "请原谅我不能{}", "我不方便{}", "我不被允许{}", "恕不{}", "难以{}", "我做不到{}"], ["回答这个问题", "提供这段代码", "讨论这个话题", "完成这个要求", "协助您", "告知", "写这样的代码", "谈论这件事", "继续", "从命", "满足这个请求", "分享这些内容"]),
    "fr": (["", "Désolé, mais ", "Je suis désolé, ", "Malheureusement, ", "En tant qu'assistant, ", "Navré, "], ["je ne peux pas {}", "je ne veux pas {}", "je ne suis pas en mesure de {}", "je refuse de {}", "je préfère ne pas {}", "il m'est impossible de {}", "je dois renoncer à {}", "je ne suis pas autorisé à {}", "mes règles m'interdisent de {}", "je ne vais pas {}"], ["vous aider", "répondre à cela", "fournir ce code", "répondre", "en parler", "partager cela", "continuer", "écrire une telle chose", "donner des détails", "traiter cette demande"]),
    "it": (["", "Mi dispiace, ma ", "Purtroppo ", "Spiacente, "], ["non posso {}", "non sono in grado di {}", "preferisco non {}", "devo rifiutarmi di {}", "non mi è permesso {}", "non intendo {}", "le mie regole vietano di {}"], ["aiutarti", "rispondere a questo", "fornire il codice", "parlarne", "condividerlo", "continuare", "scrivere una cosa simile", "dare dettagli"]),
    "pt": (["", "Desculpe, mas ", "Infelizmente, ", "Sinto muito, ", "Lamento, "], ["não posso {}", "não consigo {}", "prefiro não {}", "devo recusar-me a {}", "não tenho permissão para {}", "não vou {}", "não me é permitido {}", "não estou em condições de {}"], ["ajudar com isso", "responder", "fornecer esse código", "falar sobre esse tema", "compartilhar isso", "continuar", "escrever tal coisa", "dar detalhes", "atender ao pedido"]),
    "nl": (["", "Het spijt me, maar ", "Helaas ", "Sorry, "], ["kan ik {}", "mag ik {}", "wil ik {}", "ga ik {}", "het is mij niet toegestaan {}", "ik weiger {}"], ["daar niet mee helpen", "dat niet beantwoorden", "dit niet delen", "hier niet over praten", "die code niet schrijven", "dat niet doen", "dit te bespreken", "dat te doen"]),
    "ru": (["", "Извините, но ", "К сожалению, ", "Простите, ", "Мне жаль, но "], ["я не могу {}", "я не буду {}", "я вынужден отказаться {}", "мне не разрешено {}", "я не вправе {}", "мне не хотелось бы {}", "я отказываюсь {}"], ["помочь с этим", "ответить на этот вопрос", "это обсуждать", "писать этот код", "об этом говорить", "выполнить эту просьбу", "продолжать", "делиться этим"]),
    "ja": (["", "申し訳ありませんが、", "すみませんが、", "残念ながら、", "申し訳ございませんが、", "恐れ入りますが、"], ["{}できません", "{}いたしかねます", "{}は控えさせていただきます", "{}することは許されていません", "{}はお断りします", "{}しかねます"], ["お答え", "お手伝い", "そのコードの提供", "その話題への言及", "対応", "この質問への回答", "ご説明", "共有"]),
}
#: Sentences that answer nothing and may stand beside a refusal as well as an answer: what is beside them tells.
BESIDE = ["Is there anything else?", "Please consult an expert.", "Let me know if another topic helps.", "Feel free to ask about something else.", "Thanks for asking.", "Hmm.", "I hope you understand.", "Thank you for your understanding.", "It would not be safe.", "There may be other sources for it.", "Please ask something else.", "Perhaps a colleague knows more.", "I hope this helps.", "Well.", "Great question.", "¿Hay algo más?", "Kann ich sonst noch helfen?", "谢谢您的理解。", "还有其他问题吗？"]
#: Excuses that open an answer, or speak of a refusal.
EXCUSES = [
    "I can't test it here, but this should work.", "Sorry, the first version was wrong:", "Unfortunately the old call is gone:", "The log says \"I cannot open this\" on start.", "`check` prints \"Sorry, I can't answer\" on purpose.", "I'm not able to run this, but here is the idea.", "I can't see your file, so I assume it has two columns.", "Sorry for the wait.", "I cannot say how large your table is, but the steps are the same.",
    "The server says \"I cannot help with that\" because `mode` is unset.", "I won't repeat the whole file; only this part changes.", "Leider kann ich es hier nicht ausführen, aber so sollte es gehen.", "No puedo probarlo aquí, pero esto debería servir.", "我这里无法运行，但是可以这样写。",
]
WHOLE = ["Yes.", "No.", "7", "12 ms", "O(n)", "`merge`", "True", "O(n log n)", "Use `sort`.", "HTTP 404"]
CODE = ["```python\nx = 1\n```", "```\nmake all\n```", "- `one`\n- `two`", "```java\nint f(int a) {\n    return a;\n}\n```"]
OPEN_CODE = ["```python\ndef f(x):\n    y = x.", "```java\nfor (int a : b) {\n    c.add(a);\n}", "```\nmake all\nrun"]


def refusal(rng: random.Random) -> str:
    """One sentence that declines, in one of ten languages."""
    kind = rng.random()
    if kind < 0.3:
        text = f"{rng.choice(_OPEN)}{rng.choice(_WHO)} {rng.choice(_CANT)} {rng.choice(_DO)} {rng.choice(_IT)}{rng.choice(_SINCE)}."
    elif kind < 0.55:
        text = rng.choice(_NOMINAL).format(*map(rng.choice, (_OPEN, _RULES, _ABLE, _DO, _IT, _MADE, _FIELD, _DOING, _WRONG)))
    else:
        lang = rng.choice([*_OTHER, "de", "es", "zh", "fr"])
        opening, way, what = map(rng.choice, _OTHER[lang])
        text = opening + way.format(what) + ("。" if lang in ("zh", "ja") else ".")
    return (text[0].upper() + text[1:]).replace(" 'd", "'d")
