"""Sentences written by hand, with their personal details marked as {kind|text}; all but five of the given names are outside the list that is known.

``@`` before ten digits adds the check digit of a PESEL, ``#`` before three letters and five digits that of an identity card.
"""

SENTENCES = """
{person|Bartłomiej Nowak} prowadzi naszą scholę od dwóch lat.
Wczoraj rozmawiałem z panią {person|Żaneta Malinowska} w kancelarii.
Dziękuję, {person|Oskar Wilczyński} bardzo mi pomógł.
Na organach grał {person|Hieronim Wójcik}, a potem była kolacja.
Książkę napisała {person|Oliwia Rutkowska} i warto ją przeczytać.
Zapisy przyjmuje {person|Hubert Sikorski} po każdej mszy.
Pan {person|Igor Mroczek} naprawił dach na plebanii.
Czy ktoś zna adres, pod którym mieszka {person|Alina Przybysz}?
Modlitwę poprowadzi {person|Kacper Olejniczak}.
Za kwiaty dziękujemy pani {person|Kornelia Szulc}.
Redaktorem pisma jest {person|Borys Grabowski}, mój kolega.
{person|Tymoteusz Kwaśniewski} odpowie na pytania w niedzielę.
Zdjęcia robiła {person|Amelia Wysocka} oraz {person|Nikodem Pawłowski}.
W chórze śpiewa też {person|Milena Stachowiak}.
Świadectwo dał {person|Gustaw Brzeziński}, strażak.
Bilety sprzedaje {person|Marlena Jakubowska}, proszę do niej pisać.
Do rady wybrano {person|Teodora Lipińskiego} i {person|Anielę Zawadzką}.
List podpisał {person|Ludwik Andrzejewski}.
Kwiaty od {person|Patrycji Urbańskiej} stoją w zakrystii.
Spotkanie z {person|Ksawerym Michalskim} odbędzie się w piątek.
{person|Dagmara Bielecka} zbiera podpisy pod petycją.
Moja sąsiadka, {person|Brygida Woźniak}, ma dziewięćdziesiąt lat.
Rekolekcje głosił ks. {person|Fryderyk Jaworski}.
Pisała do mnie {person|Sandra Maciejewska} w tej sprawie.
Dr {person|Eryk Wasilewski} przyjmuje we wtorki.
Pamiętacie, jak {person|Leon Tomczak} grał na trąbce?
Zamówienie złożył {person|Feliks Sobolewski} na sto egzemplarzy.
Prof. {person|Anatol Kozłowski} wykładał dogmatykę.
Nasza katechetka to {person|Bernadeta Szymczak}.
{person|Dorian Kurek} przyniósł świece, dziękujemy.
Odpisała mi {person|Nina Sawicka} i podała termin.
Wniosek złożyła {person|Roksana Górecka-Malik} w kurii.
Dyżur ma dziś {person|Bruno Leśniak}.
Po mszy {person|Liliana Sokołowska} rozdawała chleb.
Przemawiał {person|Tymon Kalinowski}, lider wspólnoty.
Kronikę prowadzi {person|Apolonia Mikołajczyk}.
Organizatorem jest {person|Zygfryd Włodarczyk}.
Autorem ikony jest {person|Bazyli Czajkowski} spod Lublina.
Na zebraniu {person|Ernest Chojnacki} zadał dobre pytanie.
Podziękowania dla {person|Klemensa Rutkowskiego} za transport.
Proszę dzwonić do pani {person|Leokadia Błaszczyk}.
Obraz podarował {person|Alfred Szczepański}.
Wczoraj zmarł {person|Eustachy Nowicki}, prosimy o modlitwę.
Pozdrawiam, {person|Jagoda Markowska}
Pozdrawiam serdecznie, {person|Ignacja Kaczmarczyk}
Z wyrazami szacunku {person|Olgierd Zakrzewski}
Autor: {person|Lena Wiśniewska}
Podpisano: {person|Kajetan Dziedzic}
Chrzest przyjęła {person|Maja Krajewska} z rodzicami.
Kazanie spisał brat {person|Rajmund Zieliński}.
Prosił o to {person|Walenty Cichoń} z trzeciej ławki.
Zeznawał {person|Cezary Piasecki}, kierowca autobusu.
Pielgrzymkę zgłosiła {person|Adela Domańska}.
Kolega {person|Wincenty Jankowski} pisał o tym wcześniej.
Na skrzypcach zagra {person|Estera Gutowska}.
Projekt wykonał inż. {person|Seweryn Wojciechowski}.
Nauczycielka {person|Ida Kołodziejczyk} odeszła na emeryturę.
Znaleziono różaniec, zgubiła go {person|Salomea Kubacka}.
Kluczy pilnuje {person|Cyprian Matuszewski}.
Siostra {person|Kinga Ostrowska} uczy dzieci śpiewu.
Na liście jest też {person|Aurelia Wójtowicz}.
Gitarę pożyczył {person|Albert Mazurkiewicz}.
Zaproszenie dostał {person|J. Lis} i jego żona.
Kwestę prowadził {person|W. Malinowski} z parafii.
Napisał {person|K. Brzozowska} na forum w ubiegłym roku.
Pisał o tym {person|A. B. Zieliński} w liście do redakcji.
{person|Tomasz Lis} nie przyszedł na próbę.
Zupę gotował {person|Daniel Wilk} z synem.
Dzieci przygotował {person|Stefan Kos}.
Wygrał {person|Norbert Zając}, gratulujemy.
Zadzwoń do mnie: {phone|601 234 567}.
Mój telefon to {phone|22 654 32 10}, po osiemnastej.
Numer biura: {phone|+44 20 7946 0958}.
W Berlinie dzwońcie pod {phone|+49 30 123456}.
Kontakt pod numerem {phone|+48 502 333 111}.
Tel. {phone|(12) 422-33-44} wew. 3.
Proszę o sms na {phone|600-700-800}.
Kom. {phone|0048 511 222 333}, najlepiej rano.
Dzwonić {phone|795111222} w dni robocze.
Sekretariat, tel. {phone|58 301 22 33}, czynny do 15.
Biuro pielgrzymek {phone|+48 34 365 38 88}.
Zgłoszenia przyjmuję pod {phone|693.444.555}.
Fax {phone|(61) 855 12 34}.
Infolinia {phone|801 100 200} działa całą dobę.
W razie pytań {phone|+48601998877}.
Telefon do zakrystii {phone|17 852 44 11}.
Mój nowy numer to {phone|512 345 678}, stary nie działa.
Telefon dyżurny: {phone|(+48) 666 777 888}.
Organista odbiera pod {phone|71/322-14-15}.
Zadzwoń, {phone|888 123 321}.
Z Paryża proszę dzwonić na {phone|+33 1 4000 5000}.
Podaję komórkę {phone|534-222-111}.
Do księdza: {phone|32 255 66 77}.
Pomoc: {phone|116 123 456}.
Mam numer {phone|725 111 999} od roku.
Pisz na {email|bartek.nowak@poczta.example}.
Adres do wysyłki prac to {email|konkurs2024@parafia-zielona.example}.
Mój mail: {email|zaneta_m@skrzynka.example}
Zgłoszenia na {email|biuro [at] pielgrzymka [dot] example}.
Kontakt: {email|oskar(at)dolina.example}
Odpowiadam z {email|h.wojcik@organy.example} wieczorami.
Napisz do {email|oliwia małpa domowa kropka example}.
Skrzynka {email|redakcja.lokalna@gazeta.example} jest pełna.
Wysłałem na {email|igor+lista@serwer.example}, bez odpowiedzi.
Prace przyjmuje {email|k.szulc@kwiaty.example}.
Szczegóły: {email|info@chor-miejski.example}, zapraszamy.
Proszę o przelew i potwierdzenie na {email|skarbnik@wspolnota.example}.
Teksty na {email|tymek99@listy.example} do środy.
Podaję e-mail {email|amelia.wysocka@foto.example}.
Niech pisze pod {email|NIKODEM@FOTO.EXAMPLE}.
{email|kornelia.s@ogrod.example} to mój adres.
Rezerwacja: {email|dom.rekolekcyjny@gory.example}.
Można też na {email|leon-t@trabka.example}.
Archiwum pod {email|kronika@stara.parafia.example}.
Pytania do {email|feliks.s@drukarnia.example} proszę.
Mój PESEL to {id_number|@8501011234}.
We wniosku wpisz pesel {id_number|@7203154431} i datę.
Numer PESEL {id_number|@9911020987} podano w piśmie.
W umowie stoi {id_number|@6607191234}, proszę sprawdzić.
pesel: {id_number|@0124051122}
Dowód osobisty {id_number|#ABC12345} zgubiono w autobusie.
Seria i numer dowodu: {id_number|#CDE98765}.
Mam dowód nr {id_number|#XYZ45678} wydany w Łodzi.
Paszport {id_number|AB1234567} ważny do maja.
Numer paszportu {id_number|EH7654321}.
Legitymował się dowodem {id_number|#DEF11223}.
Jego PESEL, {id_number|@5805121122}, jest w aktach.
Znaleziono dokument {id_number|#GHA33445}.
Wpisz PESEL dziecka {id_number|@1521094433} w formularzu.
dowodu {id_number|#BCD56789} nie odebrano
Mieszkam przy {address|ul. Sosnowej 7}.
Paczki ślijcie na adres {address|ul. Kwiatowa 12/4, 30-001 Kraków}.
Spotkanie w domu na {address|Rynku Głównym 12, 31-042 Kraków}.
Kancelaria: {address|ul. Świętego Jana Pawła II 15/3}.
Nasz adres to {address|ul. Armii Krajowej 22}, wejście z boku.
Zapraszam na {address|Wiśniową 5}.
Dom stoi przy {address|al. Niepodległości 101}.
Przeprowadziłam się na {address|os. Tysiąclecia 14/55}.
Sklep jest przy {address|placu Kościuszki 3}.
Listy kierujcie: {address|ul. Długa 44, 80-831 Gdańsk}.
Biuro mieści się przy {address|ul. Marii Konopnickiej 9 lok. 2}.
Odbiór przy {address|ulicy Zamkowej 18A}.
Mieszkamy na {address|Grunwaldzkiej 77}, drugie piętro.
Warsztaty: {address|ul. ks. Jerzego Popiełuszki 6}.
Adres: {address|ul. Piękna 1, 00-477 Warszawa}.
Jadłodajnia przy {address|ul. Bema 23}.
Magazyn na {address|os. Leśnym 8 m. 12}.
Proszę przyjść na {address|Dworcową 31}.
Dom Kultury, {address|ul. 3 Maja 10}, sala duża.
Podaję adres {address|ul. Ogrodowa 2, 20-075 Lublin}.
Mieszka przy {address|ul. Wojska Polskiego 150}.
Remontujemy dom przy {address|ul. Szpitalnej 4}.
Tymczasowo: {address|pl. Wolności 16/8}.
Zbiórka rzeczy na {address|Kolejowej 3}.
Kurier zna {address|ul. Jasna 19 m. 7, 15-200 Białystok}.
Akcja Katolicka zaprasza na spotkanie w sobotę.
Matka Boska Ostrobramska jest patronką miasta.
Czytaliśmy Księgę Wyjścia i Dzieje Apostolskie.
W Wielki Czwartek msza będzie o osiemnastej.
Nowy Targ leży u stóp gór.
Pielgrzymka do Santiago de Compostela trwa miesiąc.
Gość Niedzielny pisał o tym w marcu.
Święty Ignacy założył zakon.
Kupiłem chleb za 12 zł i mleko za 4 zł.
Zebrano 1250 zł na remont dachu.
Psalm 23 i Psalm 91 znam na pamięć.
Por. Mt 5, 3 oraz Łk 6, 20.
Msze o 7, 9, 11 i 18.
Wersja 2.4.11 programu działa lepiej.
ISBN 978-83-240-1234-1 ma nowe wydanie.
Numer konta 12 1020 3040 0000 1111 2222 3333 jest na stronie.
W roku 1987 było 245 osób.
Ławka 12, piętro 3, sala 5.
Zamówienie 20240517 czeka na wysyłkę.
Piszę z Nowego Sącza po raz pierwszy.
Koło Żywego Różańca spotyka się w środy.
Duch Święty prowadzi Kościół.
Papież Benedykt odwiedził Polskę.
Dobry Pasterz szuka owiec.
Zielone Świątki i Boże Ciało to święta ruchome.
Kup bilet w kasie nr 4 do 15 maja.
Stacja Kraków Główny jest zamknięta.
Rada Parafialna obraduje w czwartek.
Uniwersytet Śląski ogłosił nabór.
Pozdrawiam wszystkich, którzy modlą się rano.
Moim zdaniem to był dobry rok.
Ulica Lipowa jest w remoncie.
Proszę o modlitwę za chorych z naszej parafii.
Ewangelia Marka jest najkrótsza.
Caritas Diecezjalna zbiera żywność.
Serce Jezusa, zmiłuj się nad nami.
Tydzień Modlitw zaczyna się jutro.
Czytam Tygodnik Powszechny od lat.
Morze Śródziemne jest ciepłe we wrześniu.
Stary Rynek wygląda pięknie zimą.
Dzień Dziecka obchodzimy w czerwcu.
Polskie Radio nada transmisję.
Numer 7/2021 gazety już jest.
Proszę Państwa, zaczynamy próbę.
Wypowiedź burmistrza: {person|Zenobia Ratajczak} poparła projekt.
Szukam {person|Kaliny Dobrowolskiej}, która śpiewała w {address|ul. Polskiej 5} sto lat temu.
Zapytaj o to {person|Mirona Gajewskiego} albo zadzwoń: {phone|606 505 404}.
Jestem {person|Idalia Żak}, mieszkam przy {address|ul. Rzecznej 8/2}, mail {email|idalia@rzeka.example}.
Przyszedł Mistrz Eckhart i mówił o ciszy.
Świątynia Opatrzności powstawała dwieście lat.
{person|Lis Oktawian} był sołtysem.
Wczoraj w Nowej Hucie padał deszcz.
""".strip().split("\n")
