"""Template residue and error pages (problem 9).

A document is residue when what its author left in it, after quotes,
signatures, code and markup are taken away, is nearly all residue:

* *placeholders*, each delimiter with its own grammar (``{{name}}``,
  ``[%name%]``, ``[Customer Name]``, ...),
* *filler* (dummy Latin, "your text here", "TBD", keyboard rows),
* *messages* of a server or the board software that content can't be shown,
* *notices* that scripts are required.

Placeholders are matched by regular expressions.  The other kinds are told by
closed vocabularies: a message has a thing ("page", "Datei") in a state
("expired", "nicht" + "gefunden") or an error word, a notice has scripts and
what to do with them, a filler has a slot and an order to fill it, and nearly
all content words of such a sentence belong to that language.  One word from
elsewhere ("removed from the needle") and it is somebody's sentence.  Dummy
Latin is told by its endings and by the absence of the function words of living
languages.

The text is cut into sentences.  A sentence that mentions residue (in quotation
marks or code, as advice, in the first person, as a question) is content.  The
share of residue among the letters decides, so a post that shows one
placeholder among its own sentences stays and a form letter with one field
filled in goes.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: share of residue letters from which a document is residue
DENSITY = 0.5
#: share of the content words of a sentence that may be foreign to the language of residue
FOREIGN = 0.25

_I = regex.IGNORECASE | regex.UNICODE


def _any(*patterns: str) -> regex.Pattern:
    return regex.compile("|".join(f"(?:{p})" for p in patterns), _I)


# --- what is not the author's own text -------------------------------------------------------
_TAGS = "p|div|br|b|i|u|em|strong|span|font|a|img|center|small|sup|sub|noscript|section|article|main|body|html|head|title|h[1-6]|ul|ol|li|table|tr|td|th|hr|pre|tt|abbr|blink|cite"
_HTML = regex.compile(rf"</?(?:{_TAGS})(?:\s[^<>]*)?/?>", _I)
_BB = regex.compile(r"\[/?(?:b|i|u|s|url|img|font|center|list|spoiler|email|left|right|\*)(?:=[^\]\n]*)?\]", _I)
_CODE = regex.compile(r"\[code\].*?(?:\[/code\]|\Z)|<code>.*?(?:</code>|\Z)|```.*?(?:```|\Z)", _I | regex.DOTALL)
_INLINE = regex.compile(r"`[^`\n]*`")
_QUOTES = [
    regex.compile(r"\[quote[^\]\n]*\](?:(?!\[quote).)*?(?:\[/quote\]|\Z)", _I | regex.DOTALL),
    regex.compile(r"<blockquote[^>]*>(?:(?!<blockquote).)*?(?:</blockquote>|\Z)", _I | regex.DOTALL),
    regex.compile(r"(?<!-)(?=-{3,}+\s*+Original)(?<=^\W*).*\Z", _I | regex.DOTALL | regex.MULTILINE),
    regex.compile(r"^[^\n]{1,60}\bwrote:[^\S\n]*\x1f*\n(?=\s*\x1f*\s*>)", _I | regex.MULTILINE),
    regex.compile(r"^[^\S\n]*\x1f*[^\S\n]*>[^\n]*$", regex.MULTILINE),
]
_SIZED = regex.compile(r"\[/?(?:size|color)(?:=[^\]\n]*)?\]", _I)
_SIGNATURE = regex.compile(r"(?<!\s)[^\S\n]*+\n\s*+(?:(?:--+|~{3,}|_{3,}|\*{3,}|={3,})[^\S\n]*\n(?:[^\n]*+\n?){0,4}\s*\Z|\[size=1\][^\n]*\Z|(?:cheers|regards|best|thanks|gr[uü]ße|saludos|cordialement),?[^\S\n]*\n[^\S\n]*[\p{L}\d_.-]+\s*\Z)", _I)
_FURNITURE = regex.compile(r"\b(?:home|boards?|search|contact|login|register|help|faq|top)(?:\s*[|·»/]\s*(?:home|boards?|search|contact|login|register|help|faq|imprint|privacy|top))+\b", _I)
_INVISIBLE = regex.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad]")

# --- placeholders: each delimiter has its own grammar -----------------------------------------
_NAME = r"[\p{L}][\p{L}\d_. ]{0,40}"
_WORD = r"[\p{L}][\p{L}\d_.]{0,40}"
_FIELD = regex.compile(
    "|".join(
        [
            rf"\{{\{{[#/^&]?\s*{_NAME}\s*\}}\}}", rf"\{{%\s*{_NAME}\s*%\}}", rf"<%[=-]?\s*{_NAME}\s*-?%>", rf"\$\{{\s*{_NAME}\s*\}}", rf"\$\(\s*{_NAME}\s*\)",
            rf"\[\[\s*{_NAME}\s*\]\]", rf"\[%\s*{_NAME}\s*%?\]", rf"\[(?:insert|enter|your|add|name of)\s+{_NAME}\]", rf"<<\s*{_NAME}\s*>>", rf"@@\s*{_NAME}\s*@@",
            rf"(?<![\p{{L}}\d_])__{_NAME}__(?![\p{{L}}\d_])", rf"(?<![\p{{L}}\d%])%%?{_NAME}%%?(?![\p{{L}}\d])", rf"(?<![\p{{L}}\d#&])#{_NAME}#(?![\p{{L}}\d])",
            rf"(?<![\p{{L}}\d$])\${_NAME}\$(?![\p{{L}}\d])", rf"\{{\s*{_NAME}\s*\}}", rf"<{_WORD}_[\p{{L}}\d_.]+>", r"<[A-Z][A-Z]+(?:[ _][A-Z]+)*>", rf"~~{_NAME}~~", r"<>",
            r"<(?:name|board|moderator|excerpt|author|title|date|user|email)(?:\.\p{L}+)?>",
        ]
    ),
    _I,
)

# --- fixed values: vocabularies.  A word that ends in * stands for all that begin so. -------------
#: function words of the languages covered; they say nothing about a sentence
STOP = """
a an the this that these those it its is are was were be been being am has have had having do does did done will would can could may might must shall should to of in on at by for from
with without into over under after before between through about as and or but if then than so because while when where which who whom whose what there here's you your yours he she his her they
them their we us our ours all any some each every both other another such only own same very just also too now still yet again more most much many few up out off down not no nor yes right
der die das den dem dies jene jeder alle des ein eine einer eines einem einen und oder aber wenn dann als wie so weil ist sind war waren wird werden wurde wurden sein hat haben hatte zu von im in am an auf aus bei mit nach
vor für über unter um durch ohne gegen zwischen diese dieser dieses diesem diesen es er sie wir ihr ihre ihren ihrem ihrer uns unser nur auch noch schon sehr hier dort dass man sich bitte leider zum zur vom kann können konnte konnten könnte muss lässt allen alle mit ob etwa
le la les l un une des du de d et ou mais si alors que qu qui dont où est sont était été être a ont avait avoir à au aux en dans sur sous par pour avec sans entre ce cet cette ces il elle ils elles on nous vous votre vos notre nos
son sa ses leur leurs se s y n ne pas plus très ici là aussi encore comme quand puis veuillez pu peut peuvent pourrait avant après cela ça tous toute toutes tout
el lo los las del al y o u e pero si que quien cual es son era eran fue ser está están ha han había haber a en de por para con sin sobre entre este esta estos estas ese esa su sus se le les nos usted ustedes ya más muy aquí también como cuando no un una pudo puede pueden antes después todo todos sido estado
os as um uma uns umas do da dos das no na nos nas ao à aos às pelo pela e ou mas se que quem é são foi era ser está estão há em por para com sem sobre este esta isto esse essa seu sua seus suas você vocês já mais muito aqui também como quando não pôde pode podem antes depois todo todos toda sido estado
il lo gli i un uno una di del della dei delle da dal in nel nella su sul per con tra fra e o ma se che chi è sono era essere ha hanno questo questa questi queste suo sua suoi si ci vi già più molto qui anche come quando non può possono prima dopo tutti tutto stato stata
и или но если то что как это этот эта эти этого в во на с со к ко по из за от до у о об для при без над под не ни нет да был была было были есть быть его её их вы вас вам ваш ваша ваше вашего вашем мы нас наш наша он она они уже ещё еще так же только
i lub ale jeśli że jak to ten ta te tego w we na z ze do od po za o u dla przez przy bez nad pod nie jest są był była było być jego jej ich twój twoja twoje się już tylko
ve veya ama bir bu şu o da de ile için gibi çok daha en mi değil
de het een en of maar als dan dat die dit deze is zijn was waren wordt worden heeft hebben te van in op aan bij met na voor over onder om door zonder naar niet u uw wij ons zij er hier ook nog
"""
#: negations
NOT = "not no cannot can't couldn't doesn't don't didn't hasn't haven't wouldn't shouldn't isn't aren't wasn't weren't won't unable never without nicht kein keine keinen keiner nie ohne ne n' pas plus jamais sans no nunca sin não nunca sem non mai senza не нет нельзя без nie brak bez değil yok niet geen zonder failed failure nothing nichts rien nada fehlen fehlt missing manque falta"
#: things that a server or a board shows
THING = """
page pages site sites website webpage web thread threads topic topics post posts board boards forum forums server servers service services session sessions link links url urls address request requests resource resources
file files attachment attachments document documents content contents account profile viewer reader reply replies form index system database connection message messages gateway host network domain application app object article entry view data video channel group event item access
seite seiten beitrag beiträge thema themen übersicht anhang anhänge sitzung datei dateien foren dienst inhalt inhalte anfrage verbindung adresse konto webseite website datenbank nachricht board artikel bereich zugriff video
sujet sujets pièce jointe fil fichier fichiers contenu serveur requête connexion adresse compte discussion discussions ressource données accès base vidéo
página paginas páginas tema temas mensaje mensajes archivo archivos adjunto sesión sitio servidor servicio contenido solicitud conexión dirección cuenta recurso foro datos acceso base vídeo
tópico tópicos mensagem mensagens anexo sessão arquivo servidor serviço conteúdo pedido solicitação conexão endereço conta recurso fórum dados acesso banco vídeo
pagina pagine sito sessione servizio contenuto contenuti richiesta connessione indirizzo risorsa messaggio discussione allegato dati accesso
страниц* тема темы тему сообщени* вложени* сесси* файл* сайт* сервер* сервис* служб* содержим* контент* запрос* адрес* ресурс* соединени* форум* раздел* данные доступ доступа
stron* serwer* plik* usług* sesj* witryn* zasób zasobu żądani* treś* wątek wątku
sayfa* sunucu* dosya* hizmet* içeri* oturum* konu* istek isteğ*
dienst bestand bericht berichten
"""
#: states that need no negation
STATE = """
unavailable expired reset gone moved removed deleted offline closed busy denied blocked forbidden refused unreachable overloaded exhausted interrupted suspended disabled inaccessible invalid exceeded aborted terminated broke broken failed
abgelaufen gelöscht verschoben gesperrt überlastet unterbrochen geschlossen verweigert abgelehnt entfernt unerreichbar gestört
introuvable indisponible expiré expirée supprimé supprimée déplacé déplacée fermé fermée surchargé surchargée refusé refusée interdit interdite inaccessible interrompue invalide
caducado caducada eliminado eliminada movido movida cerrado cerrada denegado denegada saturado saturada prohibido inaccesible inválida inválido
expirou expirado expirada removido removida apagado apagada fechado negado negada sobrecarregado indisponível proibido inacessível inválido
scaduto scaduta rimosso rimossa eliminato eliminata spostato spostata negato sovraccarico chiuso indisponibile vietato irraggiungibile
удален* удалён* недоступ* перегруж* истекл* истёк закрыт* запрещ* перемещ* отклон* перенес* заблокирован*
usunięt* niedostępn* przeniesion* wygas* zabronion* odmow* przeciążon*
bulunamad* silin* kapalı ulaşılam* engellen* reddedil* doldu taşın*
verlopen verwijderd verplaatst gesloten geweigerd onbereikbaar overbelast
"""
#: what cannot be done with a thing, together with a negation
DEED = """
found find loaded load shown show displayed display reached reach opened open rendered render completed complete exist exists existed existing available accessible respond responding answer processed process fulfilled fulfill serve served handle handled connect connected
access permission permissions permitted privileges rights authorized understand understood accept accepted finish finished started start allowed located retrieved retrieve read view viewed here longer work works
gefunden geladen angezeigt anzeigen erreicht erreichbar geöffnet verfügbar vorhanden existiert ausgeführt bearbeitet zugriff berechtigung verarbeitet mehr darstellen anzuzeigen aufrufen öffnen finden lesen berechtigt rechte
trouvé trouvée chargé chargée affiché affichée afficher s'afficher atteinte ouverte existe disponible accessible répond traité traitée autorisé charger permission droits trouver afficher ouvrir accéder accès
encontrado encontrada cargado cargada mostrado mostrada mostrar mostrarse cargar existe disponible accesible responde procesar completar permiso abrir abrirse cargarse permisos acceder acceso encontrar encontró encuentra pudo puede
encontrado encontrada carregado carregada exibido exibida exibir carregar existe disponível acessível responde processar concluir permissão permissões acessar acesso encontrar abrir pode pôde existiu
trovato trovata caricato caricata mostrato visualizzare caricare esiste disponibile accessibile risponde elaborare permesso permessi autorizzazione accedere accesso trovare raggiungibile può
найден* загру* показа* отобра* откры* доступ* существ* отвеча* выполн* обработ* прав*
znalezion* wyświetl* załadow* istniej* dostępn* odpowiada otworz* uprawnie* można
görüntülen* yüklen* açıl* mevcut yanıt erişim izniniz
gevonden geladen weergegeven beschikbaar bereikbaar bestaat toegang toestemming
"""
#: words that name an error or a stop by themselves
ERROR = """
error errors exception exceptions fatal oops forbidden unauthorized unauthorised timeout overloaded maintenance outage incident crashed difficulties traceback keyerror typeerror valueerror undefined stacktrace segfault
fehler fehlercode serverfehler wartung wartungsarbeiten wartungsmodus störung ausnahme zeitüberschreitung
erreur erreurs maintenance panne
mantenimiento erro erros errores manutenção errore errori manutenzione
ошибк* обслуживан* технически* сбой сбоя
błąd błęd* konserwac* przerwa
hata* bakım* fout fouten storing onderhoud onderhoudswerkzaamheden
"""
#: what messages and notices say besides
AROUND = """
warning please try later reload refresh retry return back home homepage go wait minutes minute seconds second moment moments code reference ref id ids number trace line stack permission contact administrator admin operator webmaster owner support team help staff hosting provider
internal external bad proxy time timed temporarily currently momentarily scheduled planned technical difficulty experiencing experience moved-permanently whilst problem problems issue issues trouble something anything went goes wrong occurred happened happens happen encountered encounter caused cause unexpected unexpectedly unknown end side client
check checked spelling typed type looking look looked asked requested request visit visiting existing tell told notified informed notify end apologize apologise inconvenience sorry soon shortly slow quickly hour hours today many much high heavy load traffic rate limit limits exceeded exceed limit memory size bytes byte allowed tried allocate execution
maximum method gateway upstream understandable nginx apache cloudflare varnish tomcat iis php mysql sql query wordpress phpbb vbulletin discourse ubuntu debian http https www html ray ip port not-found modified parse syntax token headers header already sent output modify include stream failed failure fail failing main null pointer index offset variable property array string json status message trace file false true
store backend cluster node think mistake ms sec secs mistaken assume believe correct incorrect wrong entered misspelled mistyped search attempt attempts follows log logged login sign signed in register user users member members private restricted quote further advised available unless until full use using used continue continuing proceed view viewing see seeing read reading access accessing show showing display displaying reach loading load loads opening rendering saving sending
versuchen versuch später erneut nochmal einmal neu laden laden aktualisieren angefordert* gewünscht* gesucht* unerwartet* unbekannt* aufrufen melden verursacht verarbeiten wurde folgend* möglicherweise zurück startseite minuten sekunden moment kontaktieren wenden administrator betreiber derzeit zurzeit momentan vorübergehend technische probleme problem aufgetreten kennung referenz interner interne unbekannter prüfen überprüfen entschuldigung augenblick kurze kürze server anmelden einloggen mitglieder bald wieder sehen lesen ansehen um zu rechte
réessayez réessayer recharger rechargez actualiser actualisez retour accueil minutes instants contacter contactez administrateur actuellement momentanément temporairement technique techniques problème survenu survenue produite interne code réf merci patienter quelques tard ultérieurement vérifiez désolé désolés attention lire voir continuer cours maintenant serveur demandé demandée demandés recherchée recherché recherchez inattendue inattendu inconnue être peut-être veuillez ressayer identifiez connectez essayez nouveau
inténtelo intente intentar intentarlo vuelva nuevo tarde recargue recargar actualice minutos contacte administrador actualmente temporalmente momento técnico problemas problema ocurrido inesperado interno código ref compruebe verifique dirección disculpe lamentamos aviso atención leer ver continuar volver inicio unos espere servidor completar lectura busca buscaba buscada solicitado solicitada intenta sentimos inicie sesión favor pasado producido desconocido mas
tente tentar novamente tarde recarregue recarregar atualize minutos contate administrador atualmente temporariamente momento técnico problemas problema ocorreu inesperado interno código ref verifique endereço desculpe lamentamos aviso atenção ler ver continuar voltar início alguns aguarde servidor instantes ligue leitura procura procurada solicitada solicitado inesperada desconhecido favor entre faça login acessar
riprova riprovare riprovi nuovo tardi ricarica ricaricare aggiorna minuti contatta contattare amministratore attualmente temporaneamente momento tecnico problemi problema verificato imprevisto interno codice verifica indirizzo spiacenti scusate attenzione leggere vedere continuare tornare attendere alcuni servizio cercata cercato richiesta richiesto minuto qualche tra più poco favore accedi sconosciuto inattesa
повтор* попроб* попыт* поздн* позже обнов* перезагруз* минут* секунд* обрат* администратор* поддержк* времен* сейчас внутренн* неизвестн* произошл* код номер проверь* извините внимание прочит* читать чтения просмотр* продолж* верн* главн* пожалуйста снова раз через адрес* ссылк* работы ведутся проводятся момент* запрашива* запрошен* неожидан* необходимо войдите время времени невозможн* удалось удается удаётся
spróbuj* później odśwież* minut* administrator* tymczasowo obecnie wewnętrzn* nieznan* wystąpił* kod sprawdź* przepraszamy uwaga proszę żądana żądany szukan* nieoczekiwan* zaloguj spróbować została został zostało ponownie jeszcze raz chwil* adres* szukana
lütfen tekrar deneyin sonra yenileyin yönetici* şu anda geçici* dahili bir istenen aradığ* beklenmeyen oluştu kod kontrol aradığınız üzgünüz dakika* biraz bekleyin
probeer opnieuw later vernieuw minuten beheerder momenteel tijdelijk interne onbekende opgetreden controleer excuses ververs terug gevraagde onverwachte probeert
"""
#: scripts and what carries them
SCRIPT = "javascript js scripts script scripting cookies cookie skripte skript skripten client-side noscript скрипт* яваскрипт çerez*"
#: what a notice wants done with scripts
ENABLE = """
enable enabled enabling activate activated active allow allowed allowing turn turned turning switch switched permit unblock unblocked run runs running require requires required need needs needed must support supported supports disabled disable blocked block blocks takes take depend depends off missing checking verify verifying verified execute
aktivieren aktiviert aktiviertes erlauben erlaubt einschalten eingeschaltet schalten zulassen zugelassen ausgeschaltet deaktiviert blockiert erforderlich benötigt benötigen braucht nötig prüfen unterstützt unterstützen führt führen ausführt ausführen
activer activez activé activés activée autoriser autorisez autorise autorisez-les activez-les désactivé désactivés bloqué bloqués requis nécessaire nécessite exécute accepte acceptez prend charge supporte
active activar activado activados habilite habilitar habilitado permita permitir bloqueados bloqueado desactivado desactivados deshabilitado necesario requiere necesita ejecuta admite soporta acepta actívelo actívelos
ative ativar ativado ativados habilitar permitir permita bloqueados bloqueado desativado desativados necessário requer precisa executa suporta aceita ative-o ative-os
attiva attivare attivato abilitare abilita abilitato abilitati consentire bloccati bloccato disattivato disabilitato necessario richiede supporta accetta
включ* разреш* отключ* выключ* заблок* необходим* требу* нуж* поддерж* выполня*
włącz* zablokowan* wymag* wyłączon* obsług* etkinleştir* gerekli gerekiyor devre aç* ingeschakeld inschakelen vereist nodig uitgeschakeld
"""
#: beside them
BROWSER = "browser browsers setting settings option options device security secure human robot bot plugin extension extensions blocker adblocker view mode full browsereinstellungen einstellungen ihrem navigateur paramètres réglages navegador ajustes configuración configurações impostazioni браузер* настройк* przeglądar* ustawie* tarayıcı* instellingen"
#: words that name filler by themselves
FILLER = "placeholder placeholders dummy lorem ipsum blindtext blindtexte platzhalter platzhaltertext platzhaltertexte fülltext mustertext beispieltext tbd tba tbc tobedone факсимиле заполнител* текст-заполнитель рыба-текст przykładow* zastępcz* yertutucu relleno preenchimento remplissage factice segnaposto riempitivo opvultekst voorbeeldtekst"
#: orders to fill a slot
FILL = """
insert enter add put type write choose replace fill describe explain edit upload paste goes here comes follow state list give tell name link your sample example supplied coming
eingeben einfügen einsetzen ersetzen eintragen hier steht stehen ihr ihre ihren beispiel folgt schreiben
insérez insérer saisissez saisir remplacez remplacer ajoutez ajouter écrivez ici votre exemple d'exemple
inserte insertar escriba escribir introduzca sustituya reemplace añada aquí su ejemplo
insira inserir escreva escrever digite substitua adicione aqui seu sua exemplo
inserisci inserire scrivi scrivere sostituisci sostituire aggiungi qui tuo vostro esempio
введите вставьте замените напишите здесь ваш ваша ваше пример образец добавьте будет
wpisz wstaw zamień tutaj tu twój przykład girin ekleyin buraya örnek invoegen vul vervang hier uw voorbeeld
"""
#: slots
SLOT = """
text texts title titles headline headlines heading subhead subheading caption captions description descriptions summary abstract teaser bio biography signature introduction intro content contents name names comment comments message body paragraph paragraphs block blocks
line lines box boxes image images picture pictures photo logo button company customer client product details detail profile project topic opening welcome post page rules board footer header lead copy quote label link email date city phone address number slogan tagline entry section column article area field note question questions answer subject copy set protocol sentences sentence
überschrift titel bezeichnung beschreibung zusammenfassung bild bilder absatz inhalt name firma firmenname unternehmen kunde datum adresse einleitung unterschrift untertitel kurzbeschreibung
texte titre description résumé légende contenu nom société entreprise client date adresse paragraphe introduction accroche sous-titre
texto título descripción resumen contenido nombre empresa cliente fecha dirección párrafo introducción
descrição resumo conteúdo nome data endereço parágrafo introdução legenda
testo titolo descrizione riassunto contenuto nome azienda cliente data indirizzo paragrafo introduzione didascalia
текст* заголов* описани* назван* подпис* абзац* имя компани* фамили* дата содержан*
tekst* tytuł* opis* nazw* akapit* metin metn* başlık* açıklama*
"""
#: beside them
DRAFT = """
created installer installed default automatically generated short long brief main real actual final draft live going publish published publishing launch replace later translate delete edit layout shows demonstration purposes purpose temporary two three characters words word max most least given provided client editor author
später kurz kurzer echten eigentlichen endgültigen ohne layout wörter zeichen entwurf dient inhalt sinn
court courte plus tard véritable définitif brouillon mots caractères maquette mise ligne
corto corta real definitivo borrador más tarde palabras caracteres curto verdadeiro definitivo rascunho palavras breve vero definitivo bozza parole
позже настоящ* короткий макет* слов symbols
"""
#: the first person
PERSON = "i i'm i've i'd i'll my me mine myself ich mir mich mein meine meinen meinem meiner je j'ai j moi mon ma mes yo mi mis conmigo eu meu minha meus comigo io mio mia miei я мне меня мной мой моя мои у́ jag mij mijn ik ja mnie mój moja moje benim bana"

# --- the same for writings without spaces: phrases that cover a sentence ---------------------------
COVER = {
    "message": "エラー 見つかりません 見つかりませんでした 存在しません 存在しない 期限が切れ 有効期限 切れています 読み込めません 読み込めませんでした 表示できません 表示できませんでした アクセス 拒否 拒否されました できません できませんでした メンテナンス中 メンテナンス 利用できません 利用いただけません 削除されました 移動しました 混み合って 応答がありません 接続できません"
    " 错误 未找到 找不到 不存在 已过期 已失效 无法 不可用 暂时 拒绝 访问被拒绝 维护中 维护 已删除 已被删除 超时 繁忙 服务器内部错误 出错 오류 찾을 수 없습니다 없습니다 만료 거부 점검 錯誤 找不到 無法 維護中 已過期",
    "notice": "javascript ジャバスクリプト スクリプト cookie クッキー 脚本 스크립트 자바스크립트",
    "filler": "ダミー ダミーテキスト サンプルテキスト サンプル文章 仮のテキスト 差し替えて 入力してください 記入してください ここに ここへ 占位 占位符 示例文本 在此输入 请在此 此处输入 替换 더미 여기에 입력하세요 예시",
    "around": "ページ サーバー サーバ 内部 投稿 スレッド トピック 添付ファイル ファイル 掲示板 コンテンツ このページ 内容 サイト セッション 記事 データ しばらくして から もう一度 再度 お試しください 試してください お待ちください 再読み込み してください ください ご確認 確認 管理者 連絡 後で 時間をおいて 一時的に 現在 お探しの 指定された 申し訳ありません お問い合わせ ただいま 有効にし 有効 有効に 必要です 必要 無効 オン オフ 許可 許可し ブラウザ ブラウザー 設定 読むには 表示するには 見るには 実行 この 発生しました コード"
    " テキスト 文章 本文 タイトル 説明 名前 見出し 画像 に が を は の も で と へ て ます ました です でした には では された されて いる います"
    " 页面 您 访问 的 网页 服务器 请求 文件 内容 网站 主题 帖子 会话 请 稍后 再试 重试 刷新 返回 首页 联系 管理员 检查 抱歉 对不起 您的 您要 正在 系统 连接 启用 浏览器 设置 需要 才能 查看 继续 已 被 禁用 允许 后 并 本 该 此 在 中 以 文本 标题 描述 名称 内部 被 了 페이지를 페이지 서버 요청 잠시 후 다시 시도 하세요 시도해 주세요 브라우저 활성화 網頁 伺服器 請 稍後 再試 頁面 啟用 瀏覽器 您",
}

# --- fixed values: the usual words of dummy Latin ----------------------------------------------------
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip
ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
aenean lacinia bibendum curabitur pellentesque vestibulum praesent vivamus mauris nunc nullam donec fusce integer maecenas morbi phasellus proin quisque suspendisse ut vel viverra volutpat vulputate egestas faucibus
fermentum gravida habitant hendrerit iaculis imperdiet interdum justo lectus leo libero ligula lobortis luctus malesuada massa mattis metus molestie nec neque nibh nisl odio orci ornare pharetra placerat porta porttitor
posuere pretium pulvinar purus rhoncus risus rutrum sagittis sapien scelerisque sem semper sodales sollicitudin tellus tempus tincidunt tortor tristique turpis ultrices ultricies urna varius vehicula velit venenatis
cras cursus dapibus diam dictum dignissim dui efficitur eget eleifend elementum erat eros euismod facilisi facilisis felis finibus fringilla ac accumsan aliquam aliquet ante arcu at auctor augue blandit condimentum congue convallis cubilia"""
#: endings of Latin words, and those that other languages share
LATIN_ENDINGS = ["um", "us", "is", "or", "em", "it", "at", "unt", "ent", "ur", "am", "ae", "que", "ex"]
SHARED_ENDINGS = ["ar", "er", "en", "as", "es", "on", "i"]


#: words that a bracketed field may be about, in [Customer Name]
_ABOUT = r"(?:name|company|customer|client|user|date|title|city|country|email|e-mail|address|phone|product|order|invoice|amount|number|link|url|subject|position|department|signature|firma|kunde|datum|adresse|nom|société|nombre|empresa|fecha|nome|data|cliente|azienda|имя|дата|компания|imię|isim|会社名|氏名|名前|日付)"

# --- contexts that make residue a mention -----------------------------------------------------
_ADVICE = _any(
    r"\b(?:replace|export|use|set|put|type|write|define|escape|expand|edit|fill)s?\b[^.]*\b(?:where|before|first|instead|then|so|in the (?:config|template|form|script|header))\b",
    r"\b(?:config|template|macro|variable|bracket|placeholder|regex|latex|jinja|syntax|literal|f-?string|key) (?:is|are|needs?|file|still|takes|works)\b",
    r"\bin (?:the|my|our|your) (?:config|template|script|makefile|consent form|header)\b", r"\btemplate (?:still )?had\b", r"\bf\"", r"\\\p{L}+\{",
)
_CITED = regex.compile(r"[\"“„«»「『][^\"“”„«»」』\n]{4,}[\"”“«»」』]")
_QUESTION = regex.compile(r"[?？]\W*$")

_UPPER = r"A-ZÀ-ÖØ-ÞĀĆĘŁŃŚŹŻİŞĞА-ЯЁ"
#: ends of sentences
_END = re.compile(rf"([.!?…:。！？])(?:\s+|(?=[{_UPPER}\[{{<⟦]))|([。！？)}}])(?=[{_UPPER}\[{{<])|([。！？])|\s([|·»–—;])\s|;(?=\s)|(?<=[a-z]{{3}}\.)(?=\d)")


def _cut(m: re.Match) -> str:
    return (m[1] or m[2] or m[3] or "") + "\n"


def own_text(text: str) -> str:
    """What the author wrote: without quotes, signature, markup; code becomes ``CODE``, a placeholder ``FIELD``."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", t)).replace("‐", "-").replace("‑", "-").replace("’", "'")
    t = _BB.sub("", _HTML.sub(BREAK, t))
    for q in _QUOTES:
        n = 1
        while n:  # one level of nesting a round
            t, n = q.subn("\n", t)
    t = t.replace(BREAK, "\n")
    if "`" in t or "code" in t.lower():
        t = _INLINE.sub(f" {CODE} ", _CODE.sub(f"\n{CODE * 4}\n", t))
    if "\n" in t:
        t = _SIGNATURE.sub("\n", "\n" + t)
    t = _SIZED.sub("", t)
    if "|" in t or "·" in t or "»" in t or "/" in t:
        t = _FURNITURE.sub("\n", t)
    t = _TRACE.sub("\nError 500:\n", _JSON.sub("\nError 500:\n", t))
    t = _BRACKETED.sub(FIELD, _FIELD.sub(lambda m: m[0] if "=" in m[0] and "<%=" not in m[0] else FIELD, t))
    return regex.sub(r"[^\S\n]+", " ", t).strip()


#: stands for a tag until the quoted lines are gone
BREAK = "\x1f"
#: stands for code in the cleaned text
CODE = "⟪⟫"
#: stands for a placeholder in the cleaned text
FIELD = "⟦⟧"
_BRACKETED = regex.compile(rf"(?<![\w\]])\[(?=[^\]\n]*{_ABOUT})[\p{{Lu}}\p{{Lo}}][\p{{L}}\d ’'/_-]{{0,40}}\](?!\()", regex.UNICODE | regex.IGNORECASE)
_JSON = regex.compile(r"\{\s*\"(?:error|status|code|message)\"[^\n}]*+\}(?:\s*\})?", _I)
_TRACE = regex.compile(r"traceback\s+\(most\s+recent\s+call\s+last\)[^\n]*\n(?:[^\S\n]+[^\n]*\n)+[^\n]*", _I)


def _gather() -> tuple[dict[str, int], dict[str, int]]:
    """(whole words, beginnings) -> bits of the vocabularies they stand in."""
    words: dict[str, int] = {}
    stems: dict[str, int] = {}
    for bit, text in enumerate((STOP, NOT, THING, STATE, DEED, ERROR, AROUND, SCRIPT, ENABLE, BROWSER, FILLER, FILL, SLOT, DRAFT, PERSON)):
        for w in text.split():
            table, key = (stems, w[:-1]) if w.endswith("*") else (words, w)
            table[key] = table.get(key, 0) | 1 << bit
    return words, stems


_WHOLE, _STEMS = _gather()
(_STOP, _NOT, _THING, _STATE, _DEED, _ERROR, _AROUND, _SCRIPT, _ENABLE, _BROWSER, _FILLER, _FILL, _SLOT, _DRAFT, _PERSON) = (1 << i for i in range(15))
_NEUTRAL = _STOP | _NOT
_STEM_SIZES = sorted({len(s) for s in _STEMS}, reverse=True)
_SEEN: dict[str, int] = {}
#: words that a worker remembers
SEEN_WORDS = 200_000


def role(word: str) -> int:
    """Bits of the vocabularies that a lower-case word stands in; 0 for a foreign word."""
    bits = _SEEN.get(word)
    if bits is None:
        bits = _WHOLE.get(word, 0) | (_WHOLE.get(word.split("'")[-1], 0) if "'" in word else 0)
        for n in _STEM_SIZES:
            if len(word) >= n:
                bits |= _STEMS.get(word[:n], 0)
        if not bits and "-" in word:
            parts = [role(p) for p in word.split("-") if p]
            bits = 0 if not all(parts) else parts[-1]
        if len(_SEEN) >= SEEN_WORDS:
            _SEEN.clear()
        _SEEN[word] = bits
    return bits


_TOKEN = regex.compile(r"[\p{L}\p{M}\d_][\p{L}\p{M}\d_'-]*|[\p{L}\p{M}]")
_PATH = regex.compile(r"(?:https?://|www\.)\S+|(?:/[\w.-]+){2,}/?|\b[\w-]+\.(?:php|html?|aspx?|jsp|js|py|com|org|net|local)\b|\S+@\S+", _I)
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_MASH = _any(r"^\W*(\p{L}+)(?:\W+\1){2,}\W*$", r"^\W*(?:x{2,}\W*){3,}$", r"^\W*(?:asdf?\p{L}{0,4}|qwertz?y?|jkl[öo]?|hjkl)(?:\W+(?:asdf?\p{L}{0,4}|qwertz?y?|jkl[öo]?|hjkl))+\W*$")
_LATIN = set(LATIN.split())
_LATIN_END = regex.compile(rf"^\p{{L}}+(?:{'|'.join(LATIN_ENDINGS)})$")
_LATIN_LIKE = regex.compile(rf"^\p{{L}}+(?:{'|'.join(LATIN_ENDINGS + SHARED_ENDINGS)})$")
_LATIN_SURE = {w for w in _LATIN if len(w) > 4 and w not in _WHOLE}
#: neighbours with such endings that make a run
LATIN_RUN = 4
#: idioms of servers that no vocabulary tells
_IDIOM = _any(r"\btoo many requests\b", r"\btimed out\b", r"\b(?:bad|proxy|gateway) (?:gateway|request|error|time-?out)\b", r"^\W*file \"[^\"]+\", line \d+", r"\bhigh (?:load|traffic)\b", r"\bsomething (?:went|has gone) wrong\b", r"\bheaders? already sent\b", r"\bcoming soon\b", r"^\W*todo\W*$")
_ORDER = regex.compile(r"^\W*\[[^\]]*\]?\W*$")
_HERE = {"here", "hier", "ici", "aquí", "aqui", "qui", "здесь", "tutaj", "buraya"}
_COME = {"comes", "goes", "go", "come", "steht", "stehen", "später", "kommt", "va", "vai", "будет", "follows", "appears"}
_FOLLOW = {"follow", "follows", "folgt", "coming", "suivre", "seguir"}
_YOUR = {"your", "ihr", "ihre", "ihren", "dein", "deine", "votre", "vos", "su", "sus", "tu", "seu", "sua", "tuo", "vostro", "ваш", "ваша", "ваше", "twój", "uw"}
_STATUS = regex.compile(r"^\W*(?:https?\W*(?:1\.[01]|2)?\W*)?(?:error|status|code|fehler|erreur|erro|errore|ошибка|エラー)?\W*[45]\d\d\b", _I)
_PAIRS = sorted(((p, k) for k, text in COVER.items() for p in text.split()), key=lambda x: -len(x[0]))
_COVERED = regex.compile("|".join(regex.escape(p) for p, _ in _PAIRS))
_KIND_OF = dict(_PAIRS)


def _letters(s: str) -> int:
    """Letters and digits; a piece of code counts as four, a placeholder as eight."""
    return sum(map(str.isalnum, s)) + 4 * s.count(CODE) + 8 * s.count(FIELD)


def _unspaced(s: str) -> bool | None:
    """A sentence in a writing without spaces: its letters that residue phrases cover, and whether a telling one is among them."""
    total = _letters(s)
    covered, kinds = 0, set()
    for m in _COVERED.finditer(s.lower()):
        covered += len(m[0])
        kinds.add(_KIND_OF[m[0]])
    words = [w for w in _TOKEN.findall(_CJK.sub(" ", s).lower())]
    covered += sum(len(w) for w in words if role(w) or any(c.isdigit() for c in w))
    if covered < 0.75 * total or regex.search(r"私|僕|うち|俺|我(?!们)", s):
        return False
    return True if kinds - {"around"} else None


def is_residue_sentence(s: str) -> bool | None:
    """True for residue, False for content, None for neither: no letters, or nothing but words that surround messages."""
    fields = FIELD in s
    ascii_ = s.isascii()
    if not ascii_ and not fields and _CJK.search(s):
        if _CITED.search(s) or _QUESTION.search(s):
            return None if _unspaced(s) is None else False
        return _unspaced(s)
    tokens = _TOKEN.findall((_PATH.sub(" ", s) if "/" in s or "@" in s or "." in s[:-1] else s).lower())
    words = [w for w in tokens if w.isalpha() or not any(map(str.isdigit, w))]
    roles = [_SEEN[w] if w in _SEEN else role(w) for w in words]
    every = content = foreign = 0
    for r in roles:
        every |= r
        if not r:
            foreign += 1
        elif r & ~_NEUTRAL:
            content += 1
    content += foreign
    if fields:
        return not (every & _PERSON or _ADVICE.search(s) or _CITED.search(s) or CODE in s or len(s.split()) > 14 * s.count(FIELD))
    if not words:
        return True if tokens and len(tokens) <= 3 and _STATUS.search(s) and not s.strip(" .").isdigit() else None
    if foreign > FOREIGN * content and len(words) > 3 and every & _STOP and not any(w in _LATIN_SURE for w in words):
        return False  # most sentences end here
    if _is_latin(s, words, roles) or len(words) > 2 and 3 * len(set(words)) <= 2 * len(words) + 3 and _MASH.search(s):
        return True
    if roles[0] & _FILL and _ORDER.search(s):
        return True
    asked = _QUESTION.search(s)
    if not content and not asked:
        return None
    sign = _IDIOM.search(s)
    if foreign > FOREIGN * content or every & _PERSON or CODE in s or (not every & _ERROR and not sign and _CITED.search(s)):
        return False
    message = every & _ERROR or sign or every & _THING and (every & _STATE or every & _NOT and every & _DEED) or every & (_THING | _AROUND | _DEED | _STATE) and _STATUS.search(s)
    notice = every & (_SCRIPT | _BROWSER) and every & _ENABLE
    if not asked and (message or notice or _is_filler(words, roles, every)):
        return True
    return False if foreign else None


def _is_latin(s: str, words: list[str], roles: list[int]) -> bool:
    """Dummy Latin: mostly its usual words, or words with Latin endings in a run and no function word of a living language."""
    if len(words) <= 3:
        return words[0] == "lorem"
    if sum(w in _LATIN for w in words) >= 0.7 * len(words) and any(w in _LATIN_SURE for w in words):
        return True
    inner = regex.findall(r"(?<=[\p{L},;]\s)\p{L}+", s)
    if any(r & _STOP and w not in _LATIN for w, r in zip(words, roles)) or sum(w[0].isupper() for w in inner) > 0.1 * len(inner) and not s.isupper():
        return False
    run = best = 0
    for w in words:
        run = run + 1 if _LATIN_LIKE.match(w) else 0
        best = max(best, run)
    return best >= LATIN_RUN and sum(bool(_LATIN_LIKE.match(w)) for w in words) >= 0.7 * len(words) and sum(bool(_LATIN_END.match(w)) for w in words) >= 0.25 * len(words)


def _is_filler(words: list[str], roles: list[int], every: int) -> bool:
    if every & _FILLER:
        return True
    if not every & _SLOT:
        return False
    placed = any(w in _HERE and (i + 1 == len(words) or words[i + 1] in _COME) for i, w in enumerate(words))
    return placed or words[-1] in _FOLLOW or roles[0] & _FILL > 0 and words[0] not in _HERE or words[0] in _YOUR


def density(text: str | None) -> float:
    """Share of residue among the letters of the author's own text; 0 for null, blank or purely quoted text."""
    if not text:
        return 0.0
    body = own_text(text)
    sentences = [s for s in _END.sub(_cut, body).split("\n") if s]
    kinds = [is_residue_sentence(s) for s in sentences]
    bad = sum(_letters(s) for s, k in zip(sentences, kinds) if k)
    if not bad:
        return 0.0
    good = 0.0
    for s in (s for s, k in zip(sentences, kinds) if k is False):
        # beside open placeholders, the filled-in sentences of the same form count half
        own = FIELD not in body or _CITED.search(s) or _ADVICE.search(s) or _QUESTION.search(s) or CODE in s or any(role(w) & _PERSON for w in _TOKEN.findall(s.lower()))
        good += _letters(s) * (1.0 if own else 0.5)
    return bad / (bad + good)


def residue(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, density`` of every document whose density is at least ``DENSITY``.

    Null, empty and blank texts are no residue; repeated rows are judged each.
    Texts of any length are read whole.  Other columns are left out.
    """

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            d = p[text].map(density)
            keep = d >= DENSITY
            yield pd.DataFrame({doc_id: p.loc[keep, doc_id], "density": d[keep]})

    some = docs.select(doc_id, text).filter(F.col(text).isNotNull())
    return some.mapInPandas(judge, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, density double")
