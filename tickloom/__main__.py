from tickloom.commands import main

raise SystemExit(main())
