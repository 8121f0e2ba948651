"""Pure Column functions: amounts, dates, text, locales, tax rules."""
