"""Column functions. Import the modules directly: ``text``, ``urls``, ``html``, ``linearize``, ``metrics``."""
