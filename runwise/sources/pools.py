"""Value pools of the person table.

Fixed values: the lists below, repeated entries included, are the domains of
the generated table and set the frequency of each value.
"""

SURNAMES = [
    "Иванов", "Петров", "Сидоров", "Кузнецов", "Смирнов", "Егоров", "Макаров", "Николаев", "Соловьев", "Волков",
    "Лебедев", "Козлов", "Новиков", "Морозов", "Кравцов", "Орлов", "Романов", "Мельников", "Ткачев", "Жуков",
    "Алексеев", "Кудрявцев", "Белов", "Федоров", "Комаров", "Киселев", "Некрасов", "Юдин", "Бобылев", "Зайцев",
    "Сахаров", "Шилов", "Буров", "Королев", "Мухин", "Калинин", "Ларионов", "Воробьев", "Фомин", "Беляев",
    "Федосеев", "Маслов", "Коновалов", "Исаев", "Чернов", "Третьяков", "Денисов", "Карпов", "Степанов",
    "Дмитриев", "Гусев", "Максимов", "Крылов", "Куликов", "Назаров", "Воронцов", "Рябинин", "Савин", "Михайлов",
    "Фокин", "Андреев", "Лихачёв", "Родионов", "Лазарев", "Соколов", "Григорьев", "Попов", "Анисимов", "Ершов",
    "Макеев", "Гаврилов", "Тихомиров", "Кондратьев", "Акимов", "Аксёнов", "Быков", "Лялин", "Панов", "Болдырев",
    "Данилов", "Верещагин", "Копылов", "Симонов", "Дорофеев", "Терентьев", "Киреев", "Щербаков", "Трофимов",
    "Мартынов", "Емельянов", "Юрьев", "Рутковский",
]

NAMES = [
    "Александр", "Алексей", "Анатолий", "Андрей", "Антон", "Аркадий", "Арсений", "Артём", "Богдан", "Борис",
    "Вадим", "Валентин", "Валерий", "Василий", "Виктор", "Виталий", "Влад", "Владимир", "Вячеслав", "Георгий",
    "Глеб", "Григорий", "Даниил", "Денис", "Дмитрий", "Евгений", "Егор", "Иван", "Игорь", "Илья", "Кирилл",
    "Константин", "Лев", "Леонид", "Максим", "Марат", "Матвей", "Михаил", "Никита", "Николай", "Олег", "Павел",
    "Пётр", "Ринат", "Роман", "Руслан", "Сергей", "Станислав", "Тарас", "Тимофей", "Фёдор", "Филипп", "Юрий",
    "Яков", "Ян", "Ярослав", "Алекс", "Альберт", "Антонин", "Артур", "Бронислав", "Вениамин", "Витольд",
    "Владислав", "Геннадий", "Георгий", "Герман", "Давид", "Донат", "Дорофей", "Ефим", "Захар", "Иван",
    "Изяслав", "Казимир", "Ким", "Леонтий", "Матвиенко", "Мирослав", "Нестор", "Олегарх", "Платон", "Равиль",
    "Радий", "Ростислав", "Рудольф", "Савва", "Соломон", "Степан", "Фадей", "Федосей", "Эдуард", "Эмиль",
    "Юлиан", "Юлий",
]

PATRONYMICS = [
    "Александрович", "Сергеевич", "Дмитриевич", "Петрович", "Владимирович", "Иванович", "Андреевич",
    "Николаевич", "Олегович", "Геннадиевич", "Михайлович", "Евгеньевич", "Федорович", "Алексеевич",
    "Ярославович", "Георгиевич", "Степанович", "Юрьевич", "Юдинович", "Данилович", "Владиславович", "Наумович",
    "Савелиевич", "Артёмович", "Романович", "Давидович", "Тимофеевич", "Русланович", "Вячеславович",
    "Анатольевич", "Матвеевич", "Виталиевич", "Григорьевич", "Васильевич", "Семёнович", "Станиславович",
    "Леонидович", "Игоревич", "Павлович", "Яковлевич", "Венедиктович", "Платонович", "Зиновьевич", "Елизарович",
    "Кузьмич", "Петухович", "Афанасьевич", "Бориславич", "Демидович", "Викентьевич", "Венцеславович",
    "Жданович", "Лазаревич", "Кириллович", "Иоаннович", "Демьянович", "Родионович", "Русландирович",
    "Софониевич", "Лукьянович", "Федосьевич", "Константинович", "Гаврилович", "Радиславович", "Тихонович",
    "Фадеевич", "Герасимович", "Данильевич", "Лаврентьевич", "Назарьевич", "Глебович", "Казимирович",
    "Исидорович", "Сергеевич", "Емельянович", "Леонтевич", "Никонович", "Парамонович", "Кузьминич", "Ильич",
    "Львович", "Ермакович", "Валериевич", "Савинич", "Агафонович", "Артамонович", "Добрынич", "Леопольдович",
    "Онуфриевич", "Юринич", "Арсентьевич", "Венцеславович", "Генрихович", "Альбертович", "Ильясович", "Кимович",
    "Михеевич", "Рустамович", "Эдуардович", "Юрьевич",
]

STREETS = ["Lenina", "Pushkina", "Gagarina", "Sovetskaya", "Pobedy"]
CITIES = ["Moscow", "Saint Petersburg", "Kazan", "Ekaterinburg", "Novosibirsk"]

# First and last year, both included.
BIRTH_YEARS = (1950, 2000)
RECORD_YEARS = (2020, 2022)

PHONE_PREFIX = "+7"
