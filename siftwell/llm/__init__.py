"""Training-data operators: decontamination, deduplication, language and quality models, tokenisation, URL and license scans."""
