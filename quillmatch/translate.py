"""Messages of the command line in the language of the settings."""

from __future__ import annotations

RU = {
    "Finds similar parts of source codes.": "Ищет похожие части исходных кодов.",
    "Modify and show settings.": "Изменение и просмотр настроек.",
    "Change settings.": "Изменить настройки.",
    "Show settings.": "Показать настройки.",
    "Search for similar works.": "Искать похожие работы.",
    "Work with reports.": "Работа с отчётами.",
    "Write a report.": "Записать отчёт.",
    "Here is nothing to modify: name a setting.": "Нечего изменять: назовите настройку.",
    "--repo-regexp chooses among the repositories of --github-user, which is missing.": "--repo-regexp выбирает из репозиториев --github-user, а он не задан.",
    "--path-regexp needs directories, a user or links to choose from.": "--path-regexp выбирает из каталогов, ссылок или пользователя, а они не заданы.",
    "Give both root paths or none.": "Укажите оба корневых пути или ни одного.",
    "Give each value once; given more than once: {}": "Значения не должны повторяться: {}",
    "There is no directory '{}'.": "Нет каталога '{}'.",
    "There is no file '{}'.": "Нет файла '{}'.",
    "There are no reports.": "Отчётов нет.",
    "Stopped.": "Остановлено.",
    "The run failed.": "Запуск не удался.",
}
_language = "en"


def use(language: str) -> None:
    global _language
    _language = language


def tr(message: str, *values) -> str:
    text = RU.get(message, message) if _language == "ru" else message
    return text.format(*values) if values else text
