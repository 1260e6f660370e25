"""Template residue, filler, error pages and script notices in place of content.

Texts are cut into blocks (lines; code fences and indented code left out).  Numbers, addresses, dates and ids are
masked and blocks grouped by the exact hash of what remains; each distinct message is classified once.  Besides, every
word that notices don't share is masked too, which gives a message's shape: notices carry names of their own, so it
is shapes whose recurrence is counted, over all texts and sources.

Phrase and placeholder rules name a kind outright.  A message that only joins two notions of a notice (a thing and what
became of it: a page, not found; scripts, to be switched on), in any of ten languages, is one where its shape recurs in
several texts and sources, where it makes up most of its text, or where nothing but page furniture stands around it.
The classes are joined back by hash; a text takes one kind, that of most residue characters.

Only lines that hold a cue of the rules or two notions, or stand on a page of furniture, are looked at.  A message of a
third of all texts is combined before its shuffle, distinct messages are spread over all tasks by hash, and the join
back carries ids and hashes.

Defined results: null and empty texts have no residue; repeated rows each come out; ids repeated in the input are
separate texts only if their rows differ (doc_id is the key of the result); code, inline code and quoted passages
don't count.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cairn.llm.language import FUNCTION_WORDS
from cairn.llm.near_duplicates import in_filter, id_filter
from cairn.runtime import cut, distinct_names

KINDS = ["placeholder", "filler", "error_page", "script_notice"]
_FENCE = re.compile(r"(?s)(?:^|\n)[ \t]*(?:```|~~~).*?(?:\n[ \t]*(?:```|~~~)|$(?![\s\S]))")
_SPAN = r"`[^`\n]*+`"
_QUOTED = r"\"[^\"\n]{3,200}+\"|“[^”\n]{3,200}+”|「[^」\n]{2,100}+」|«[^»\n]{3,200}+»"
_SENTENCE = r"(?<=[.!?。！？])\s+|(?<=[。！？])(?=\S)"

#: Slots left unfilled, as they stand in prose.
SLOT = (
    r"\{\{\s*[\w.\-| ]{1,60}\s*\}\}|\{%-?\s*\w+[^%\n]{0,60}%\}|<%[=\-]?\s*[\w.\-@ ]{1,60}\s*%>|\$\{[\w.\-]{1,60}\}|%%[A-Za-z_][\w ]{0,40}%%|(?<![\w%])%[A-Z][A-Z_]{2,40}%(?![\w%])|(?<![\w_])__[A-Z][A-Z0-9_]{1,40}__(?![\w_])|(?<![\w#])#[A-Z][A-Z_]{2,40}#(?![\w#])|\[%\s*\w+\s*%\]|\{#\w+#\}|\[\[\s*[\w.]{1,40}\s*\]\]|@@[A-Za-z_][\w.]{0,40}@@|(?<![\w$])\$[A-Z][A-Z_]{2,40}\$(?![\w$])|(?<![\w{$])\{[A-Za-z_][\w.]{0,40}\}(?![\w}])"
    r"|(?i:\[\s*(?:insert|your|enter|add|put|fill in|type|choose|select|tbd|todo|placeholder)\b[^\]\n]{0,50}\]|<\s*(?:insert|your|enter|add|put|fill in|tbd|todo)\b[^>\n]{0,50}>|\[(?:[a-z]+ ){0,2}(?:name|title|date|company|address|email|e-mail|number|phone|city|country|product|url|link|here)\]|\(\s*(?:insert|your|enter)\s[^)\n]{0,40}\bhere\s*\)|\{\s*(?:your|insert)[ _][^}\n]{0,40}\})"
)
#: Slots by their shape: a name between doubled signs, a name in capitals in brackets, blanks to fill in.
SLOT_SHAPE = (
    r"|<<\s*\p{L}[\p{L}\w .\-]{0,40}>>|\[\[\s*\p{L}[\p{L}\w .\-]{0,40}\]\]|\(\(\s*\p{L}[\p{L}\w .\-]{0,40}\)\)|\{\{\s*\p{L}[\p{L}\w .\-]{0,40}\}\}|(?<!#)##\s?[A-Z][A-Z_ ]{2,40}\s?##(?!#)|(?<!\$)\$\$[A-Z][A-Z_ ]{2,40}\$\$|(?<!:)::[A-Z][A-Z_]{2,40}::(?!:)|~~[A-Z][A-Z_ ]{2,40}~~"
    r"|[<\[{][A-Z]+(?:[_ ][A-Z]+)+[>\]}]|(?<!\S)_{5,}(?=[\s.,;:!?)])|\bX{2,}(?:[-/. ]X{2,})+\b"
)
#: Words of dummy Latin.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
_LATIN_SURE = [w for w in LATIN if len(w) >= 4 and w not in ("magna",)] + ["sed", "magna"]
FILLER = (
    r"(?i)\bcontent goes here\b|\b(?:your|insert|add|put|some|more|the) (?:text|content|copy|description) (?:goes |comes )?here\b|\bthis is (?:just |only )?(?:a )?(?:placeholder|dummy|sample|filler|example) (?:text|content|paragraph|copy)\b|\bplaceholder text (?:for|goes|here)\b|\breplace (?:it|this)(?: text)? (?:before publishing|with (?:your|real|the actual))|^\W*(?:\[?(?:sample|dummy|placeholder|example|filler) (?:paragraph|text|content)\]?[\s.]*){1,40}$"
    r"|\bblindtext\b|\bplatzhaltertext\b|\bbeispieltext\b|\bhier steht (?:später|bald|demnächst)? ?(?:ein|der|ihr) (?:text|inhalt)|\bfülltext\b|\btexto de (?:relleno|ejemplo|prueba|muestra)\b|\bescriba aquí su\b|\bcontenido de (?:relleno|ejemplo|prueba)\b|\b(?:este|esto) es (?:un )?texto de\b"
    r"|\btk(?:tk)+\b|\b(?:text|copy|content|intro|body) (?:is )?(?:to be (?:supplied|added|written|provided)|tbd|tba)\b|\b(?:faux texte|texte (?:d'exemple|provisoire|de remplissage)|testo (?:di esempio|segnaposto|provvisorio)|texto (?:de exemplo|provisório|fictício)|voorbeeldtekst|opvultekst|рыба-текст|текст-заполнитель)\b|ダミーテキスト|サンプルテキスト"
    r"|占位(?:文本|文字|符|内容)|(?:此处|这里)(?:为|是|填写|输入|放置)[^。]{0,8}(?:文本|内容|文字)|请替换为|示例(?:文本|文字|内容)|测试文本"
)
#: Words of a line that says the same one to three words over and over: least words, most letters of a word.
REPEATED_WORDS, REPEATED_LETTERS = 5, 12
ERROR_LINE = (
    r"(?i)^\W*(?:(?:http )?(?:error|fehler|status)?[\s:#]*(?:400|401|403|404|405|408|410|429|500|502|503|504)\b[\s:|–—-]*)?(?:error[\s:]*)?(?:bad request|unauthori[sz]ed|(?:page |file |object )?not found|forbidden|access (?:denied|forbidden)|method not allowed|gone|request time-?out|too many requests|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)\W*$"
    r"|^\W*(?:http )?(?:error|fehler)[\s:#]*(?:4|5)\d\d\W*$|^\W*(?:4|5)\d\d(?: error| fehler)\W*$"
)
ERROR = (
    r"(?i)^\W*(?:access (?:is |was )?denied\b|(?:sorry|oops|uh[- ]oh|whoops)\b[^.]{0,10}[!,.]? *(?:something went wrong|(?:the|this|that) (?:page|file|item)|we (?:could|can|can't|couldn't)|an error)|something went wrong (?:on our|while|at our)|an? (?:unexpected |internal |unknown )?(?:server )?error (?:has )?occurred\b|(?:the|this|your) (?:site|page|website|web page|server) (?:can't|cannot|can not|could not|couldn't) be (?:reached|found|displayed|loaded)|this site can't\b|this (?:page|site) (?:isn't|is not) (?:available|working)|(?:the |this )?(?:page|site|service|server|resource)(?: is)? (?:temporarily |currently )?(?:unavailable|not available|down|offline|under maintenance)"
    r"|service (?:is )?(?:temporarily |currently )?unavailable|too many requests\. |you have been (?:rate[- ]limited|blocked|banned|logged out|signed out)|you don't have permission|you do not have permission|you are not (?:authori[sz]ed|allowed) to (?:view|access|see)|you(?:r| do not| don't|'ve)? (?:must|need to|have to) (?:log|sign) in\b|(?:please )?(?:log|sign) in (?:again )?to (?:see|view|continue|access|read|get)|your (?:session|login|token) (?:has )?(?:expired|timed out|ended)|session (?:has )?(?:expired|timed out)|your (?:request|ip|access|connection|address)\b[^.]{0,60}\b(?:was|has been|is|were) (?:blocked|denied|rejected|refused|banned|limited)|your ip\b"
    r"|the requested (?:url|page|resource|file|document|address)\b[^.]{0,120}(?:not found|could not be found|does not exist|doesn't exist|was not|is not|no longer)|(?:the|this) (?:page|file|document|url|\w+) you (?:asked for|requested|are looking for|were looking for|wanted|tried to (?:open|reach)|followed)\b[^.]{0,60}(?:is gone|gone|not|no longer|doesn't|does not|moved|removed|missing|deleted|can't|cannot|could)|we (?:could not|couldn't|cannot|can't|were unable to|are unable to|failed to) (?:load|find|open|show|display|reach|serve|process|complete) (?:this|that|the|your)\b[^.]{0,40}\W*$|we (?:could not|couldn't) (?:load|find|open|show) (?:this|that|the|your) \w+\b|we(?:'re| are) (?:sorry|down|offline|currently)|this (?:page|content|item|link|article|\w+) (?:has been|was|is) (?:removed|deleted|moved|no longer available|unavailable|gone)|(?:the )?(?:gateway|server|host|upstream|backend) (?:did not|didn't|failed to|does not|took too long) |error (?:establishing|connecting|loading|processing|while|code:?)\b|(?:unable|failed|could not|cannot) to? ?(?:connect|reach|load)\b|[\w.\-]+ (?:is|are) (?:currently |temporarily )?down (?:for|at the moment|right now)\b|check the (?:address|url) and try\b|go back or (?:write|contact|return)\b|incident (?:id )?⟦id⟧|nothing (?:lives|is|was|exists|can be found|to see)\b[^.]{0,20}\b(?:here|address|url|location)\b|unusual traffic|checking (?:if the site connection|your browser before)|verify (?:that )?you are (?:a )?human|are you a robot|please complete the captcha|ddos protection|sign-?in required|login required|authentication required|please (?:log|sign) in\b"
    r"|seite nicht gefunden|die (?:gewünschte|angeforderte|gesuchte|aufgerufene) (?:seite|datei|url)|(?:der )?zugriff (?:wurde )?verweigert|ihre sitzung ist|bitte melden sie sich an|(?:es ist )?ein (?:interner )?(?:server)?fehler (?:ist )?aufgetreten|diese seite (?:ist|existiert|wurde|kann)\b|dienst (?:ist )?(?:vorübergehend )?nicht (?:erreichbar|verfügbar)|zu viele anfragen|(?:die|diese) (?:web)?site ist nicht erreichbar"
    r"|(?:la |esta )?página (?:no (?:encontrada|existe|disponible|se encuentra)|que (?:busca|buscas|solicitó|solicita)|solicitada)|acceso (?:denegado|restringido|prohibido)|su sesión (?:ha )?(?:expir|caduc)|(?:inicie|debe iniciar) sesión|ha ocurrido un error|se ha producido un error|error interno|servicio (?:temporalmente )?no disponible|demasiadas (?:solicitudes|peticiones)|algo (?:salió|ha salido) mal)"
    r"|(?:页面|网页|您(?:要)?(?:访问|查找|请求)的(?:页面|内容|网页)|该页面|此页面|文件)[^。]{0,12}(?:不存在|未找到|找不到|已被删除|已删除|无法(?:显示|访问|找到))|^\W*(?:访问被拒绝|拒绝访问|禁止访问|无权访问|服务器(?:内部)?错误|服务(?:暂时)?不可用|请求过于频繁|请(?:先)?登录|会话已过期|登录已过期|您没有权限|系统(?:繁忙|错误|维护))|(?:登录|会话|登陆)[^。]{0,6}(?:已过期|已失效|超时)|您的(?:请求|访问|IP)[^。]{0,10}(?:被拦截|被阻止|被拒绝|被限制)"
)
SCRIPT = (
    r"(?i)(?:^|[.!] )\W*(?:please )?(?:enable|activate|allow|turn on|switch on|accept) (?:cookies|javascript|js|scripts|java script|your browser's javascript)\b|\b(?:javascript|js|scripts|scripting|cookies?)(?: support)?(?: and (?:cookies|javascript|js))? (?:is|are|must be|needs? to be|has to be|have to be|seems? to be|appears? to be)(?: currently)? (?:disabled|required|turned off|switched off|turned on|switched on|off|blocked|needed|enabled (?:to|in order|for)|not (?:enabled|available|supported|running))\b"
    r"|\b(?:page|site|app|application|website|content|service|viewer|\w+) (?:requires|needs|relies on|depends on|only works with|won't work without|does not work without|doesn't work without|cannot run without) (?:javascript|js|cookies|scripts)\b|\byou (?:need|have|must)(?: to)? (?:enable|activate|allow|turn on|switch on) (?:javascript|js|cookies|scripts)\b|\b(?:switch|turn) (?:javascript|js|scripts|scripting|cookies) (?:back )?on\b|\b(?:works?|viewed|used) best with (?:javascript|js|scripts|cookies)\b|\bbrowser (?:has|blocks?|blocked|with) (?:javascript|js|scripts|cookies) ?(?:blocked|disabled|turned off|off)?|\b(?:turn|switch) (?:on )?(?:javascript|js|scripts|scripting|cookies)(?: back)?(?: on)?\b[^.]{0,40}(?:browser|reload|continue|go on|page|see|view|read)|\bwe use (?:scripts|javascript|cookies) to (?:draw|show|render|display|build|load)\b|\byour browser (?:does not|doesn't|can't|cannot) (?:run|support|execute|allow)[^.]{0,30}(?:scripts?|javascript|js|cookies)\b|\b(?:without|no) (?:javascript|scripts|cookies)[^.]{0,20}(?:cannot|can't|will not|won't|nothing)|\b(?:scripts?|javascript|cookies)\b[^.]{0,20}\bplease allow\b|\b(?:allow|enable|activate|permit|unblock|turn on|switch on)\b[^.]{0,15}\b(?:javascript|js|scripts|cookies)\b(?=\W*$|[^.]{0,12}\b(?:to|and|then|please|first)\b)|\bplease (?:allow|enable|turn on|activate|accept)\b[^.]{0,30}\b(?:scripts?|javascript|js|cookies)\b|\benable (?:cookies|javascript|js)\b[^.]{0,30}\b(?:to (?:view|see|continue|use|read)|view the)\b|\bscripting is\b|\bnoscript\b"
    r"|\b(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:java ?script|cookies|skripte)|\bjavascript (?:ist|muss|wurde)\b[^.]{0,30}(?:deaktiviert|aktiviert|ausgeschaltet|erforderlich|benötigt)|\b(?:benötigt|erfordert|braucht) (?:javascript|cookies|skripte)|\b(?:active|habilite|activa|habilita|permita|encienda) (?:javascript|las cookies|los scripts|cookies)|\bjavascript (?:está|es|debe)\b[^.]{0,30}(?:desactivado|deshabilitado|necesario|activado|requerido)|\b(?:requiere|necesita) (?:javascript|cookies)"
    r"|(?:启用|开启|打开|允许|激活)[^。]{0,12}(?:javascript|js|脚本|cookies?)|(?:javascript|脚本|cookies?)[^。]{0,8}(?:被禁用|已禁用|未启用|已关闭|必须|需要)|(?:需要|必须)[^。]{0,12}(?:javascript|脚本|cookies?)|浏览器[^。]{0,12}(?:不支持|禁用了)[^。]{0,8}(?:javascript|脚本|js)"
)
#: Turns of phrase that speak about such things.
ABOUT = (
    r"(?i)⟦code⟧|⟦quote⟧|\bwe ask (?:users|readers|people|visitors)\b|\balso works? (?:with|without)\b|\beven (?:with|without|if|when)\b|\bonly for\b|\bbecause\b|\bmeans (?:that|the)\b|\bif the\b|\bwhen the\b|\bwhich \w+ed\b|\bour \w+ tests?\b|\btokeni[sz]er\b|\bin the template\b|\btemplates?\b.{0,20}\bwrite\b|\bfor example\b|\be\.g\.|\bsuch as\b|\breturns? (?:a |an )?(?:status|http|\d)|\bstatus code\b|\bgateway answers\b|\bto (?:test|debug|reproduce|check) \b|\bthe (?:handler|server|client|proxy|parser) (?:shows|returns|answers|sends|says|logs|prints|raises|writes)\b|\b(?:how|why) (?:to|do|does|we)\b|\buses? the (?:word|phrase|string)\b|\bthe (?:word|phrase|string|message|notice|text|error) (?:⟦|of|that|is shown|appears)|\bsogenannt|\bzum beispiel\b|\bpor ejemplo\b|例如|比如"
)
#: Page furniture – rows of links, trails, footers with a year, and single words as a menu.
FURNITURE = re.compile(r"(?i)^\s*[^\W_][\w\-]*(?: [\w\-]+){0,2}(?:\s[|>»/·]\s[^\W_][\w\-]*(?: [\w\-]+){0,2}){1,40}\s*$|^\s*(?:©|copyright)[^.]{0,60}$")
MENU_WORD = re.compile(r"^\s*[^\W\d_a-z][^\W\d_]+\s*$")
#: A page that holds furniture and no more than this is a notice, whatever it says.
PAGE_LINES, PAGE_CHARS = 4, 260
#: Texts and sources in which a shape recurs, and share of its text that a message makes up, for two notions to suffice.
RECURS, SOURCES, MOST = 3, 2, 0.5
#: Beginnings of words for the notions of a notice – what it is about and what became of that; scripts and
#: what is to be done with them.
THINGS = (
    "page,site,website,web site,url,link,file,document,server,service,address,resource,session,access,request,connection,account,host,seite,datei,dokument,dienst,zugriff,sitzung,anfrage,verbindung,adresse,página,sitio,archivo,documento,servicio,servidor,acceso,sesión,solicitud,petición,conexión,dirección,"
    "fichier,serveur,accès,requête,demande,connexion,adresse,pagina,sito,servizio,accesso,sessione,richiesta,connessione,indirizzo,arquivo,serviço,acesso,sessão,pedido,solicitação,conexão,endereço,bestand,toegang,sessie,verzoek,verbinding,adres,страниц,сайт,файл,сервер,доступ,сесси,запрос,ページ,サイト,ファイル,サーバ,アクセス,セッション,页面,网页,网站,服务器,会话,请求,链接"
).split(",")
STATES = (
    "not found,not be found,does not exist,doesn't exist,no longer,unavailable,not available,denied,forbidden,expired,timed out,blocked,went wrong,gone,unreachable,not respond,offline,refused,nicht gefunden,existiert nicht,nicht verfügbar,verweigert,abgelaufen,gesperrt,nicht erreichbar,fehlgeschlagen,nicht mehr,"
    "no encontrad,no existe,no disponible,denegad,prohibid,expirad,expiró,caducad,bloquead,no se encuentra,introuvable,n'existe,n’existe,indisponible,pas disponible,refusé,interdit,expiré,bloqué,non trouvé,échoué,non trovat,non esiste,non disponibile,negat,scadut,bloccat,vietat,"
    "não encontrad,não existe,indisponível,não disponível,negad,proibid,expirou,niet gevonden,bestaat niet,niet beschikbaar,geweigerd,verlopen,geblokkeerd,verboden,не найден,не существует,недоступ,запрещ,истек,заблокирован,отказано,見つかりません,存在しません,利用できません,拒否,期限切れ,許可されていません,不存在,未找到,找不到,无法访问,被拒绝,已过期,不可用"
).split(",")
SCRIPTS = "javascript,java script,cookies,scripts,skripte,scripting,скрипт,スクリプト,クッキー,脚本".split(",")
SWITCHES = (
    "enable,activat,allow,turn on,switch on,turned off,switched off,required,requires,disabled,needs,need to,support,accept,blocked,permit,aktivier,erlaub,einschalt,deaktiviert,benötigt,erforderlich,zulass,activ,habilit,desactivad,deshabilitad,requier,necesit,permit,acept,désactiv,autoris,requis,nécessaire,besoin,"
    "attiv,abilit,disattiv,richied,richiest,necessar,consent,ativ,desativ,requer,inschakel,uitgeschakeld,vereist,nodig,включи,отключен,требуется,необходим,разреш,有効,無効,必要,启用,开启,禁用,允许,需要"
).split(",")
#: What a line must hold to be looked at – the start of a slot, one of these words, or one of these signs.
SLOT_LEADS = ("{", "<%", "${", "%", "__", "#", "@@", "$", "[", "<", "(", "::", "~~", "xx")
SLOT_START = r"(?:\{[\w{%#]|<%|\$\{|%%|%[A-Z]|__[A-Z]|#[A-Z]|@@|\$[A-Z]|\[[\w\[% ]|<\s*(?i:insert|your|enter|add|put|fill|tbd|todo)|\(\s*(?i:insert|your|enter)|<<|\[\[|\(\(|<[A-Z]|\[[A-Z]|\{[A-Z]|##\s?[A-Z]|\$\$[A-Z]|::[A-Z]|~~[A-Z]|_____|XX)"
CUE_WORDS = (
    "tktk,to be supplied,to be added,to be written,to be provided,tbd,tba,faux texte,texte,testo,texto,voorbeeldtekst,opvultekst,lorem,ipsum,dolor,amet,adipiscing,eiusmod,tempor,labore,magna,aliqua,consectetur,placeholder,dummy,filler,goes here,comes here,text here,content here,copy here,description here,replace it,replace this,before publishing,blindtext,platzhaltertext,beispieltext,fülltext,"
    "steht,relleno,de ejemplo,de prueba,de muestra,escriba,es texto,es un texto,sample text,sample paragraph,sample content,example text,example paragraph,example content,"
    "javascript,js,scripts,script,scripting,noscript,cookies,cookie,browser,browsers,skripte,"
    "error,errors,fehler,400,401,403,404,405,408,410,429,500,502,503,504,denied,forbidden,wrong,be reached,unavailable,not available,offline,is down,are down,down for,maintenance,repair,too many requests,request timeout,request time,bad request,permission,authorized,authorised,unauthorized,unauthorised,"
    "login,log in,sign in,sign-in,signed out,logged out,session,expired,timed out,requested,you asked for,looking for,could not,couldn't,cannot,can't,unable to,failed to,been removed,been deleted,been moved,was removed,was deleted,was moved,is removed,is gone,gone,unusual traffic,captcha,robot,a human,gateway,"
    "nothing lives,nothing is,nothing was,nothing exists,nothing can,nothing to see,check the address,check the url,go back,incident,unable to connect,error connecting,ddos,was blocked,been blocked,is blocked,were blocked,was rejected,was refused,was denied,been banned,rate limited,rate-limited,been limited,not found,took too long,did not answer,"
    "gefunden,gewünschte,angeforderte,zugriff,sitzung,melden sie,nicht erreichbar,nicht verfügbar,anfragen,aufgetreten,diese seite,página,acceso,sesión,no disponible,solicitudes,peticiones,salió,salido,ha ocurrido,ha producido"
).split(",")
CUE_SIGNS = "рыба-текст текст-заполнитель ダミーテキスト サンプルテキスト 占位 替换 示例 测试文本 此处 这里 浏览器 脚本 启用 开启 页面 网页 不存在 访问 拒绝 服务器 登录 会话 过期 权限 系统 请求 文件 内容".split()


def _latin_share(t: Column) -> Column:
    words = F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != "")
    return F.when(F.size(words) >= 5, F.size(F.filter(words, lambda w: w.isin(LATIN))) / F.size(words)).otherwise(0.0)


def _repeats(t: Column) -> Column:
    words = F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != "")
    kinds = F.array_distinct(words)
    few = ((F.size(words) >= REPEATED_WORDS) & (F.size(kinds) == 1)) | ((F.size(words) >= 2 * REPEATED_WORDS) & (F.size(kinds) == 2)) | ((F.size(words) >= 3 * REPEATED_WORDS) & (F.size(kinds) == 3))
    return few & ~F.exists(kinds, lambda w: (F.length(w) > REPEATED_LETTERS) | (F.length(w) < 2))


def _masked(raw: Column) -> Column:
    """Numbers (but status codes), addresses, dates, ids, inline code and quotations give way to marks."""
    m = F.regexp_replace(F.regexp_replace(raw, _SPAN, "⟦code⟧"), _QUOTED, "⟦quote⟧")
    m = F.regexp_replace(m, r"https?://\S+|\b[\w.\-]{1,64}@[\w\-]{1,63}\.[\w.]{1,63}|\b[\w\-]{1,63}(?:\.[\w\-]{1,63}){0,6}\.(?:com|org|net|io|example|test|invalid)\b(?:/\S*)?", "⟦address⟧")
    m = F.regexp_replace(m, r"\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", "⟦date⟧")
    m = F.regexp_replace(m, r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", "⟦id⟧")
    return F.regexp_replace(m, r"(?<![\w\d])(?!(?:40[013458]|410|429|50[0234])\b)\d++(?:[.,:]\d++){0,6}", "0")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("word", CUE_WORDS), ("sign", CUE_SIGNS), ("slot", SLOT_LEADS), ("thing", THINGS), ("state", STATES), ("script", SCRIPTS), ("switch", SWITCHES)):
        for w in words:
            a.add_word(w, [*a.get(w, []), (kind, len(w))])
    a.make_automaton()
    return a


_SLOT_START = re.compile(SLOT_START)
_ABOUT = re.compile(ABOUT.replace("⟦code⟧", "`").replace("⟦quote⟧", "[\"“”「«]"))
#: Words that make a sentence a condition; what it says then happens sometimes.
_IF = re.compile(r"\b(?:if|when|whenever|unless|until|once|wenn|falls|sobald|bis|si|cuando|mientras|quand|lorsque|tant que|se|quando|als|wanneer|which|that (?:is|are|was|were|does|has|have)|если|когда|пока)\b|如果|当|若|もし|場合", re.I)
_STOPS = re.compile(r"[.!?。！？\n]")
#: Words that shapes keep: of function, and those the notions and cues are made of.
_KEPT = frozenset(w for words in FUNCTION_WORDS.values() for w in words) | frozenset(w for x in (*THINGS, *STATES, *SCRIPTS, *SWITCHES, *CUE_WORDS) for w in re.findall(r"[^\W\d_]+", x))
_SHAPE = re.compile(r"[^\W_]+|[^\w\s]")


def shape(line: str) -> str:
    """What notices of one making share: a line with every other word and every number masked, in lower case."""
    out = []
    for w in _SHAPE.findall(line.lower()):
        mark = w if w in _KEPT or not w[0].isalnum() or ord(w[0]) > 0x2E7F else "⟦w⟧"
        if mark != "⟦w⟧" or out[-1:] != [mark]:
            out.append(mark)
    return " ".join(out)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _notions(line: str, found: list[tuple[int, int, str]]) -> str | None:
    """The kind that two notions in one sentence of a line make, unless it speaks about such things."""
    if _ABOUT.search(line):
        return None
    stops = [m.start() for m in _STOPS.finditer(line)]
    seen: dict[int, set[str]] = {}
    for at, _, kind in sorted(found):
        kinds = seen.setdefault(bisect_left(stops, at), set())
        if kind != "state" or "thing" in kinds:  # "page not found", but not "a blocked page"
            kinds.add(kind)
    bounds = [-1, *stops, len(line)]
    told = [kinds for k, kinds in seen.items() if not _IF.search(line, bounds[k] + 1, bounds[k + 1])]
    if any({"script", "switch"} <= kinds for kinds in told):
        return "script_notice"
    return "error_page" if any({"thing", "state"} <= kinds for kinds in told) else None


def candidate_lines(text: str, automaton: ahocorasick.Automaton) -> tuple[bool, int, list[tuple[str, str | None]]]:
    """(whether the text is a page of furniture, characters of its prose, lines to be looked at with the kind that their
    notions make).  One pass of one automaton over the text."""
    prose = _FENCE.sub("\n", text)
    lines = [x for x in prose.splitlines() if x.strip()]
    menu = [x for x in lines if MENU_WORD.match(x)]
    trail = [x for x in lines if FURNITURE.match(x)]
    rest = [x for x in lines if not MENU_WORD.match(x) and not FURNITURE.match(x)] if trail or len(menu) >= 3 else []
    page = bool(rest) and len(rest) <= PAGE_LINES and sum(map(len, rest)) <= PAGE_CHARS
    ends = [m.start() for m in re.finditer("\n", prose)] + [len(prose)]
    hit, notions, low = set(), {}, _lower(prose)
    for end, marks in automaton.iter(low):
        for kind, n in marks:
            start = end - n + 1
            if kind == "slot":
                if _SLOT_START.match(prose, start):
                    hit.add(bisect_left(ends, end))
                continue
            if start and low[start - 1].isalnum() and low[start] < "\u2e80" and kind != "sign":
                continue
            if kind == "word" and end + 1 < len(low) and low[end + 1].isalnum():
                continue
            if kind in ("word", "sign"):
                hit.add(bisect_left(ends, end))
            else:
                notions.setdefault(bisect_left(ends, end), []).append((start, end, kind))
    at = 0
    for k, e in enumerate(ends):  # the same word soon again
        if k not in hit:
            w = low[at:e].split(None, 4)[:4]
            if len(w) == 4 and w[0] in w[1:]:
                hit.add(k)
        at = e + 1
    kinds = {}
    for k, found in notions.items():
        begin = ends[k - 1] + 1 if k else 0
        if len({x for _, _, x in found}) > 1:
            kinds[k] = _notions(prose[begin : ends[k]], [(a - begin, b, c) for a, b, c in found])
    if page:
        known = {prose[ends[k - 1] + 1 if k else 0 : ends[k]]: kind for k, kind in kinds.items()}
        return True, len(prose.strip()), [(x, known.get(x)) for x in rest]
    return False, len(prose.strip()), [(prose[ends[k - 1] + 1 if k else 0 : ends[k]], kinds.get(k)) for k in sorted(hit | {k for k, kind in kinds.items() if kind})]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    types = (pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.string(), pa.string())
    for b in batches:
        out = []
        for i, source, text in zip(*[c.to_pylist() for c in b.columns]):
            page, chars, lines = candidate_lines(text, automaton)
            for x, notion in lines:
                if x.strip():
                    out.append((i, source, page, len(x.strip()) / max(1, chars), xxhash.xxh64_intdigest(shape(x)) - (1 << 63), notion, x))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "source", "page", "share", "shape", "notion", "raw"])


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per prose line of a text that may be residue: doc_id, source, page, share (of the text), shape, notion
    (kind that its notions make), size, masked, hash.

    ``page`` marks the lines of a text that is page furniture (menus, trails, footers) around a short notice."""
    rows = distinct_names(docs, [key, "source", text]).where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), "source", text)
    line = rows.mapInArrow(_lines, "doc_id long, source string, page boolean, share double, shape long, notion string, raw string")
    line = line.where(~F.col("raw").rlike(r"^(?: {4,}|\t)")).withColumn("raw", F.trim(F.regexp_replace("raw", r"^\s*(?:[-*+>]\s+|\d+[.)]\s+|#{1,6}\s+){1,8}", "")))
    code = F.col("raw").rlike(r"[;{}]\s*$|^(?:@\w|//|/\*|\*/?|#!|import |from \w+ import|package |def |class |async |public |private |protected |static |export |const |let |var |val |fun |function |return\b|if ?\(|for ?\(|while ?\()|^\w[\w.\[\]]* ?[+\-*/|&]?= \S|^\w+(?:\.\w+){1,8}\(.*\)\s*$") & ~F.col("raw").rlike(r"^[\p{Lu}][\p{L}']* [^;={}]*[.!?]$")
    line = line.where((F.col("raw") != "") & (F.col("page") | ~(code & ~F.col("raw").rlike(r"endblock|%\}|\}\}"))))
    masked = line.withColumn("masked", _masked(F.col("raw")))
    return masked.select("doc_id", "source", "page", "share", "shape", "notion", F.length("raw").alias("size"), "masked", F.xxhash64("page", F.lower(F.regexp_replace("masked", r"\s+", " "))).alias("hash"))


def kind_of(t: Column, page: Column) -> Column:
    """Kind of a masked message; null for content.  What a page of mere furniture says is a notice of some kind."""
    about = t.rlike(ABOUT)
    slot = t.rlike(SLOT + SLOT_SHAPE) & t.rlike(r"(?:\p{L}{2,40}[^\p{L}]{1,20}){2}|^\W*[\p{L}]{2,}") & ~about
    sentences = F.split(t, _SENTENCE)
    filler = ((_latin_share(t) >= 0.8) & ~about) | (t.rlike(FILLER) & ~about) | _repeats(t)
    some = lambda rx: F.exists(sentences, lambda x: x.rlike(rx) & ~x.rlike(ABOUT))
    error = t.rlike(ERROR_LINE) | some(ERROR)
    return F.when(slot, "placeholder").when(filler, "filler").when(some(SCRIPT), "script_notice").when(error, "error_page").when(page & t.rlike(r"(?i)\bjavascript\b|\bjs\b|\bscripts?\b|\bcookies?\b"), "script_notice").when(page & ~about, "error_page")


def recurring(found_blocks: DataFrame, texts: int = RECURS, sources: int = SOURCES) -> DataFrame:
    """shape of the messages that recur: in so many texts and sources.  Counted over all texts; a shape of very many
    texts is combined before its shuffle."""
    per_source = found_blocks.where("notion is not null").groupBy("shape", F.coalesce("source", F.lit("")).alias("source")).agg(F.count_distinct("doc_id").alias("n"))
    return per_source.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("s")).where((F.col("n") >= texts) & (F.col("s") >= sources)).select("shape", F.lit(True).alias("recurs"))


def messages(found_blocks: DataFrame) -> DataFrame:
    """Distinct messages over all sources: hash, residue_kind by the rules (null: none).  Copies are combined before the
    shuffle, and the rules, which cost most, run on as many tasks as there are partitions."""
    m = found_blocks.groupBy("hash").agg(F.min("masked").alias("masked"), F.max("page").alias("page"))
    parts = int(found_blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by another key than the groups', or it is dropped; written, or the rules are pushed into the few tasks before
    spread = cut(m.repartition(parts, F.xxhash64("hash")), "distinct-messages")
    return spread.withColumn("residue_kind", kind_of(F.col("masked"), F.col("page"))).select("hash", "residue_kind")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, residue_kind: one row per text with residue; of several kinds the one of most characters, ties in the
    order script_notice, error_page, placeholder, filler."""
    b = cut(blocks(docs), "blocks")
    kinds = cut(messages(b).where("residue_kind is not null"), "messages")
    rank = F.when(F.col("residue_kind") == "script_notice", 3).when(F.col("residue_kind") == "error_page", 2).when(F.col("residue_kind") == "placeholder", 1).otherwise(0)
    by_rule = b.join(kinds, "hash").select("doc_id", "residue_kind", "page", "size")
    weak = b.where("notion is not null").join(kinds.select("hash"), "hash", "left_anti")
    by_notion = weak.join(recurring(b), "shape", "left").where(F.col("recurs") | F.col("page") | (F.col("share") >= MOST)).select("doc_id", F.col("notion").alias("residue_kind"), "page", "size")
    # on a page of furniture a script notice is what it is about, beside whatever its footer says
    per = by_rule.unionByName(by_notion).groupBy("doc_id", "residue_kind").agg(F.sum("size").alias("size"), F.max(F.col("page") & (F.col("residue_kind") == "script_notice")).alias("first"))
    return per.groupBy("doc_id").agg(F.max_by("residue_kind", F.struct("first", "size", rank)).alias("residue_kind"))


def kept(docs: DataFrame) -> DataFrame:
    """The corpus without the texts that hold residue.  A filter of fixed size over their ids lets nearly all other
    texts stay where they are; only what it lets in doubt is joined."""
    ids = cut(found(docs).select("doc_id"), "residue-ids")
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    @F.pandas_udf(BooleanType())
    def doubted(i: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, i.to_numpy(np.int64)))

    marked = docs.withColumn("_doubted", doubted(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))) & F.col("doc_id").isNotNull())
    return marked.where("not _doubted").drop("_doubted").unionByName(marked.where("_doubted").drop("_doubted").join(ids, "doc_id", "left_anti"))
