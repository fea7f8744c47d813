"""Writers: messages, time-chunked tables and keyed change logs."""
