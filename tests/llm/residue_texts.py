"""Texts written by hand, none of the kind the test tables hold: residue and people's posts in many languages."""

RESIDUE = """
Dear [Customer Name], thank you for contacting [Company].
502 Proxy Error
Please turn JavaScript on and reload the page.
This site can't be reached.
Access Denied. You don't have permission to access this resource.
Application error: a client-side exception has occurred
Just a moment... Enable cookies to continue
Aenean lacinia bibendum nulla sed consectetur. Cras mattis consectetur purus sit amet fermentum.
La pagina richiesta non è stata trovata.
Strona nie została znaleziona.
页面未找到。请稍后再试。
Aradığınız sayfa bulunamadı.
Si è verificato un errore interno del server. Riprova più tardi.
Serwer jest tymczasowo niedostępny. Spróbuj ponownie później.
您访问的页面不存在或已被删除。
Sunucu hatası oluştu. Lütfen daha sonra tekrar deneyin.
404 Not Found nginx
Error 403 Forbidden
HTTP 503 Service Unavailable
500 - Internal Server Error
The requested URL was not found on this server.
The page you are looking for has been moved or deleted.
Sorry, this content is not available at the moment.
Sorry, something went wrong. Please try again later.
Oops! That page can't be found.
This topic has been closed or removed.
Your session has expired. Please log in again.
You must be logged in to view this page.
The service is temporarily unavailable due to maintenance downtime or high load. Please try again later.
Error establishing a database connection
Fatal error: Allowed memory size of 134217728 bytes exhausted
Warning: Cannot modify header information - headers already sent
Gateway Time-out. The server didn't respond in time.
Site is currently under maintenance. We will be back shortly.
Bad Request. Your browser sent a request that this server could not understand.
The connection was reset while the page was loading.
Database error: query failed.
We are experiencing technical difficulties. Please check back later.
This account has been suspended.
An unexpected error occurred while processing your request.
Request timed out. Please refresh the page.
Die angeforderte Seite wurde nicht gefunden.
Diese Seite ist zurzeit nicht erreichbar.
Der Server ist wegen Wartungsarbeiten vorübergehend nicht verfügbar.
Zugriff verweigert. Sie haben keine Berechtigung, diese Seite anzuzeigen.
Es ist ein unerwarteter Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Dieser Inhalt wurde gelöscht oder ist nicht mehr verfügbar.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich neu an.
La page demandée est introuvable.
Une erreur est survenue. Veuillez réessayer plus tard.
Le site est actuellement en maintenance.
Accès refusé. Vous n'avez pas la permission de voir cette page.
Votre session a expiré. Veuillez recharger la page.
Ce contenu n'est plus disponible.
Lo sentimos, la página que busca no existe.
Ha ocurrido un error inesperado. Inténtelo de nuevo más tarde.
El sitio está en mantenimiento.
Acceso denegado. No tiene permiso para ver esta página.
Su sesión ha caducado.
El contenido solicitado ya no está disponible.
Página não encontrada.
Ocorreu um erro inesperado. Tente novamente mais tarde.
O site está em manutenção.
Acesso negado. Você não tem permissão para acessar esta página.
A sua sessão expirou. Recarregue a página.
Este conteúdo não está mais disponível.
Страница не найдена.
Произошла ошибка. Попробуйте позже.
Сайт временно недоступен. Ведутся технические работы.
Доступ запрещён. У вас нет прав для просмотра этой страницы.
Время сессии истекло.
Сервер перегружен. Повторите попытку позже.
ページが見つかりませんでした。
内部サーバーエラーが発生しました。
現在メンテナンス中です。しばらくお待ちください。
アクセスが拒否されました。
お探しのページは存在しません。
服务器内部错误，请稍后重试。
访问被拒绝。
网站维护中。
请启用JavaScript以继续。
Pagina non disponibile.
Il server non risponde. Riprova tra qualche minuto.
Accesso negato.
Pagina niet gevonden.
Er is een fout opgetreden. Probeer het later opnieuw.
Błąd serwera.
JavaScript is disabled in your browser. Please enable it to continue.
You need to enable JavaScript to run this app.
This website requires cookies. Please enable cookies in your browser settings.
JavaScript must be enabled to view this content.
Please enable JavaScript and cookies to continue.
Checking if the site connection is secure. Enable JavaScript and cookies to continue.
Diese Seite benötigt JavaScript. Bitte aktivieren Sie JavaScript in Ihren Browsereinstellungen.
Veuillez activer JavaScript dans votre navigateur.
Por favor, active JavaScript en su navegador.
Ative o JavaScript para continuar.
Per continuare abilita JavaScript nel tuo browser.
Включите JavaScript в настройках браузера.
このサイトを表示するにはJavaScriptを有効にしてください。
Włącz obsługę JavaScript w przeglądarce.
Hello {{first_name}}, your order {{order_id}} has shipped.
Dear {customer_name}, your appointment is on {date}.
Hi %FIRSTNAME%, welcome to %COMPANY%!
Sehr geehrte Frau ${lastname}, Ihre Bestellung ${order} ist unterwegs.
Estimado [Nombre del cliente]: su pedido [Número de pedido] está listo.
[Insert title here]
[Your Name], [Your Address], [City]
Cher [Nom], merci pour votre commande.
<FIRST_NAME> <LAST_NAME> sent you a message.
Kind regards, [Name] [Position] [Company]
{{ post.title }} {{ post.body }}
Уважаемый [Имя], ваш заказ готов.
Hello [[name]], click here: [[unsubscribe_link]]
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Curabitur blandit tempus porttitor. Nullam quis risus eget urna mollis ornare vel eu leo.
Donec sed odio dui. Vestibulum id ligula porta felis euismod semper.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.
Your text here
Insert description here.
Sample text. Replace this text with your own content.
Placeholder text
Add your caption here
Enter your message here...
Title goes here
Dies ist ein Blindtext.
Hier steht Ihr Text.
Votre texte ici
Escriba aquí su texto
Insira seu texto aqui
Inserisci qui il testo
Введите текст здесь
ここにテキストを入力してください
在此输入文本
TBD
Text to follow.
Coming soon
bla bla bla bla
asdf asdf qwertz
xxx xxx xxx xxx
test test test test
"""

POSTS = """
The thread was removed from the needle.
Yesterday the server was overloaded and the guild raid was cancelled.
Blindtext ist ein Wort aus der Typografie.
I get a 404 whenever I open the wiki, does anyone else see this?
The error bars in figure 3 look far too small to me.
My session at the conference starts at ten, come by if you like.
The page about fermentation was well written, thanks for the link.
We closed the window because of the noise from the street.
Does anybody know why my script stops after the second sample?
Found a lovely little bakery behind the station this morning.
The post office was closed, so the parcel goes out on Monday.
You can replace the butter with olive oil, works fine.
Here is the recipe for the bread from last weekend.
Your argument about the tax makes sense, but the numbers are old.
In JavaScript you declare constants with const, not var.
I disabled JavaScript in Firefox and the site became much faster.
The cookies were still warm when the kids came home.
Enable the second channel and turn the gain down a bit.
Please send me the file by Friday, the deadline is close.
The content of sugar in these drinks is absurd.
His account of the war was published in 1922.
The requested samples arrived on dry ice this morning.
An unexpected guest arrived while we were having dinner.
The service at the restaurant was slow but the food was great.
Something went wrong with the second PCR, the bands are smeared.
The forum in Rome is best visited in the early evening.
No, the museum is not available for weddings, I asked.
The old bridge was closed after the flood and never opened again.
Maintenance of the boiler costs about two hundred a year.
The board rejected the proposal by a narrow margin.
This topic was discussed at length in the faculty meeting.
Permission to land was denied twice because of fog.
The tests failed because the fixture used a different locale.
Lorem ipsum is dummy text that printers have used since the sixteenth century.
The template uses {{name}} where the customer's name goes, remember to quote it.
Use ${HOME} instead of the full path in the config file.
Type your password slowly, the keyboard in the lab is terrible.
Add two eggs, a pinch of salt and stir until smooth.
Insert the card with the chip facing up and wait for the beep.
Write a short summary of the paper for Thursday's club.
My name is Anna and I moved here from Riga last spring.
The title of the book escapes me, something with whales.
The image quality of the new scanner is really impressive.
Check the spelling of the species names before you submit.
Thanks, that fixed it!
Same here, nothing works since the update on Tuesday.
Reloaded the page twice and now the plot shows up, weird.
How do I switch on the lamp of the microscope?
The link you posted leads to a blank page on my phone.
We try again tomorrow when the wind is weaker.
Who moved my cheese? A classic.
All bikes found after midnight are brought to the depot.
The head of the department was removed last week.
Seeing the exhibition without a ticket is not possible on Sundays, sadly.
Loading the truck took us three hours in the rain.
Der Fehler lag am Kabel, jetzt läuft alles.
Die Seite mit den Rezepten finde ich klasse, danke fürs Teilen.
Gestern war die Bibliothek geschlossen, also lernen wir im Café.
Der Zug war wegen Bauarbeiten nicht erreichbar, wir nahmen den Bus.
Kann mir jemand sagen, warum mein Skript beim zweiten Lauf abbricht?
Die Sitzung des Gemeinderats dauerte bis Mitternacht.
Bitte bringt zum Grillen eigene Teller mit.
Das Thema Wolf bewegt hier im Dorf alle.
Der Inhalt des Pakets war leider zerbrochen, der Händler ersetzt es.
Im Beitrag von Maria fehlt die Quelle für die zweite Zahl.
La page 12 du manuel explique comment monter l'étagère.
Le serveur du restaurant nous a apporté le mauvais plat.
Mon fils a perdu son sac dans le train, quelqu'un l'a trouvé ?
Le sujet de l'examen était plus facile que prévu.
J'ai rechargé la batterie toute la nuit et la voiture démarre.
La session d'automne commence lundi, n'oubliez pas vos cahiers.
Le message de ma grand-mère m'a fait pleurer de rire.
La página del periódico trae hoy un artículo sobre abejas.
El servidor de la cafetería fue muy amable con nosotros.
¿Alguien sabe por qué no abre la farmacia los jueves?
El archivo municipal guarda cartas del siglo XVI.
Mi mensaje era una broma, no te enfades.
El tema de la tesis me lo propuso mi directora.
A página do livro estava rasgada, mas li mesmo assim.
O servidor público pediu mais documentos para a matrícula.
A sessão de cinema começa às nove, levem casaco.
Alguém encontrou as chaves do laboratório?
O conteúdo da palestra foi ótimo, parabéns ao grupo.
Мой поезд опоздал на два часа, ужинали в полночь.
Страница из дневника деда хранится у нас дома.
Кто-нибудь нашёл ошибку в третьей задаче?
Тема сочинения в этом году была про море.
Сервер в столовой принёс нам чай и пирожки.
昨日のラーメンはとても美味しかったです。
このスクリプトを動かすと僕の環境ではメモリが足りなくなります。
猫がサーバーの上で寝ていて可愛い。
週末に京都のお寺を見に行きました。
昨天的会议讨论了新的预算方案。
我的页面设计得了奖，很开心。
La pagina sportiva di oggi parla solo della finale.
Il sito archeologico apre alle otto, conviene arrivare presto.
Ho trovato un errore nel bilancio e l'ho segnalato al capo.
Strona z przepisami babci zaginęła podczas przeprowadzki.
Serwer w bibliotece huczy jak odkurzacz.
Sayfa kenarlarına not almayı çok seviyorum.
De pagina over tulpen vond ik erg mooi geschreven.
We got an internal server error on the booking site, so we simply phoned them.
"Access denied" flashed on the screen and everybody laughed.
The poster said "Lorem ipsum" in huge letters and nobody at the printer noticed.
Our intern shipped a newsletter that began with Dear [First Name], and 3000 people got it.
Fionupernia zamaekomus, Bokegedroia stouvonamuii and Kiotriosumonas doudoustiii grow on this medium.
Quercus robur and Fagus sylvatica dominate the northern slope.
Habeas corpus was suspended during the war, which historians still debate.
Salve, qualcuno usa Linux per la didattica?
Ok
+1
See the attached table for the raw counts.
Nice photo!
Good post, saved.
Is the mirror down?
The connection between diet and sleep was not found in our cohort.
Session three covers gateways, proxies and how requests are cached.
Requests from students should go to the secretary's office.
The data was deleted by accident, but the backup tape saved us.
Broken link in the second paragraph, could you fix it please, John?
The stadium gates open at five, the game begins at seven.
"""


def texts(block: str) -> list[str]:
    return [t for t in block.strip().split("\n") if t.strip()]


#: written after the vocabularies had been extended by what the first lists showed
RESIDUE_LATER = """
We couldn't find the page you requested.
The application is temporarily offline. Please try again in a few minutes.
Error code 1020: access denied by the server.
This video is unavailable.
Sorry, you are not allowed to view this content.
The file you requested was removed.
Your request could not be processed at this time.
Connection to the database failed.
Diese Datei existiert nicht mehr.
Die Verbindung zum Server wurde unterbrochen.
Für diesen Bereich fehlen Ihnen die Rechte.
Le fichier demandé n'existe pas.
Le serveur est surchargé, veuillez patienter.
El servidor no responde. Vuelva a intentarlo más tarde.
Esta página ha sido eliminada.
O arquivo solicitado foi removido.
Erro interno do servidor.
Il contenuto richiesto è stato rimosso.
Файл удалён или недоступен.
Внутренняя ошибка сервера.
ファイルが見つかりません。
该页面已被删除。
Scripts are blocked. Allow scripts to view this page.
Ihr Browser unterstützt kein JavaScript.
Votre navigateur n'accepte pas les cookies.
Su navegador no tiene JavaScript activado.
Hi {name}, your code is {code}.
Dear #FIRST_NAME#, your invoice #INVOICE_NO# is due.
Liebe(r) [Name], anbei Ihre Rechnung.
[Company Name] [Street Address] [Phone]
Maecenas faucibus mollis interdum. Morbi leo risus, porta ac consectetur ac.
Write your headline here
Ihr Text hier
Texto de ejemplo. Reemplace este texto.
TODO
"""

POSTS_LATER = """
The bakery is closed on Tuesdays, I learned the hard way.
My request for leave was denied again.
Our connection flight was cancelled, so we slept at the airport.
The file cabinet is locked and nobody has the key.
Try again with fresh yeast, mine came out fine.
The server dropped a tray of glasses.
The document from 1840 mentions a mill at this spot.
I could not find the trailhead in the fog.
Der Bereich hinter dem Haus gehört der Gemeinde.
Die Rechnung kam doppelt, ich habe sie reklamiert.
Le fichier audio dure trois heures, courage.
El camarero no responde a las reseñas.
O arquivo do meu avô tem fotos de 1920.
Файл с расписанием лежит на общем диске у Тани.
このファイルは昨日友達が送ってくれました。
I allow scripts only for the sites I trust.
Your code is much cleaner than what we had.
Dear colleagues, the seminar moves to room 12.
Write to the editor, they usually answer.
Text me when you arrive.
Error rates doubled after the new reagent came in.
Cookies with walnuts need two more minutes.
The access road is flooded near the farm.
Maintenance crews cut down the birch in front of our office.
Is JavaScript still worth learning in 2024?
"""
