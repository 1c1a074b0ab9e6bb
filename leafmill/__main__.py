from leafmill.cli import main

raise SystemExit(main())
