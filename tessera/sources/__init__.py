"""From files, mails and pages to units of text."""
